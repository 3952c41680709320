"""Landed literature replies as a data source: batches of ids planned as partitions, filters on ids pushed into the plan.

A search or a metadata fetch asks for ids in batches, and each batch's reply is landed as one file of JSON
lines, named for its first id. `spark.read.format("landed")` plans the batches that the pushed filters leave, each
by itself while they are few and else in partitions of up to a few megabytes, and reads each reply by itself: a reply that cannot be read is one row with an error,
and the others come out; more failures than are tolerated stop the query.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Ids that one call asks for.
BATCH_IDS = 50
#: Bytes of replies that one partition reads, what opening a reply counts for beside its own bytes, and the partitions up to which each has one batch.
PARTITION_BYTES, OPEN_BYTES, FEW_PARTITIONS = 4 << 20, 4 << 10, 64
SCHEMA = "pmid long, title string, abstract string, journal string, year int, batch long, error string"
_NAME = re.compile(r"replies-(\d+)\.jsonl$")


def _files(path: str):
    """A folder's file system and its place there."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root


class Batch:
    """One reply, and which of its ids are asked for."""

    def __init__(self, first: int, path: str, wanted: set[int] | None, least: int | None, most: int | None) -> None:
        self.first, self.path, self.wanted, self.least, self.most = first, path, wanted, least, most

    def has(self, pmid: int) -> bool:
        return (self.wanted is None or pmid in self.wanted) and (self.least is None or pmid >= self.least) and (self.most is None or pmid <= self.most)


class Batches(InputPartition):
    """Replies that one task reads, one after the other: in another process than the one that planned them."""

    def __init__(self, batches: list[Batch]) -> None:
        self.batches = batches


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("batchids", BATCH_IDS))
        self.wanted: set[int] | None = None
        self.least, self.most = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ids and ranges of ids choose batches and rows here; everything else is left to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("pmid",) or isinstance(value, bool) or not isinstance(value, (int, tuple, list)):
                yield f
            elif isinstance(f, EqualTo):
                self._only({value})
            elif isinstance(f, In):
                self._only({v for v in value if v is not None})
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = value + isinstance(f, GreaterThan)
                self.least = low if self.least is None else max(self.least, low)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = value - isinstance(f, LessThan)
                self.most = high if self.most is None else min(self.most, high)
            else:
                yield f

    def _only(self, ids: set[int]) -> None:
        self.wanted = ids if self.wanted is None else self.wanted & ids

    def partitions(self) -> list[Batches]:
        from pyarrow import fs

        system, root = _files(self.path)
        firsts = {n // self.size * self.size for n in self.wanted} if self.wanted is not None else None
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if (m := _NAME.search(info.path)) and (firsts is None or int(m[1]) in firsts):
                first = int(m[1])
                if (self.least is None or first + self.size > self.least) and (self.most is None or first <= self.most):
                    found.append((Batch(first, info.path, self.wanted and {i for i in self.wanted if first <= i < first + self.size}, self.least, self.most), info.size))
        # A task costs more than a small reply: neighbours share one up to a size, so their number grows with the bytes only.
        most = min(PARTITION_BYTES, sum(n + OPEN_BYTES for _, n in found) // FEW_PARTITIONS) if len(found) > FEW_PARTITIONS else 0
        out, room = [], 0
        for batch, n in sorted(found, key=lambda x: x[0].first):
            if n + OPEN_BYTES > room:
                out.append(Batches([]))
                room = most
            out[-1].batches.append(batch)
            room -= n + OPEN_BYTES
        return out

    def read(self, partition: Batches) -> Iterator[tuple]:
        system, _ = _files(self.path)
        for batch in partition.batches:
            yield from self._replies(system, batch)

    def _replies(self, system, batch: Batch) -> Iterator[tuple]:
        rows = []
        try:
            with system.open_input_stream(batch.path) as f:
                for line in f.read().decode().splitlines():
                    r = json.loads(line)
                    rows.append((int(r["pmid"]), r.get("title"), r.get("abstract"), r.get("journal"), r.get("year"), batch.first, None))
        except (OSError, ValueError, KeyError, TypeError) as failure:
            # One call that failed costs its own ids only.
            yield None, None, None, None, None, batch.first, f"{type(failure).__name__}: {failure}"[:200]
            return
        yield from (r for r in rows if batch.has(r[0]))


class LandedReplies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def land(papers: DataFrame, path: str, size: int = BATCH_IDS, cut: Column | None = None) -> None:
    """Writes replies (pmid and what a reply has) as one file for each batch of ids, all in parallel.

    This is the recording side of a fetch: each task writes its own batches. Where `cut` holds a reply broke off.
    """
    system, root = _files(path)
    system.create_dir(root, recursive=True)
    fields = [c for c in papers.columns if c != "pmid"]
    line = F.to_json(F.struct(F.col("pmid"), *fields))
    line = line if cut is None else F.when(cut, F.substring(line, 1, 9)).otherwise(line)
    rows = papers.select((F.floor(F.col("pmid") / size) * size).cast("long").alias("first"), "pmid", line.alias("line"))
    dealt = rows.repartition("first").sortWithinPartitions("first", "pmid").select("first", "line")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, _ = _files(path)
        at, lines, n = None, [], 0

        def close() -> None:
            with own.open_output_stream(f"{root}/replies-{at}.jsonl") as f:
                f.write("".join(x + "\n" for x in lines).encode())

        for b in batches:
            for first, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if first != at and lines:
                    close()
                    n, lines = n + 1, []
                at = first
                lines.append(line)
        if lines:
            close()
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def fetched(spark: SparkSession, path: str, size: int = BATCH_IDS) -> DataFrame:
    """The replies of a folder; filters on pmid choose the batches that are read. The session's filter pushdown for such sources is switched on.

    Each use with filters of its own needs a call of its own: Spark keeps a loaded source's first plan.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedReplies)
    return spark.read.format("landed").option("batchIds", size).load(path)


def failures(replies: DataFrame, tolerated: int = 1) -> DataFrame:
    """One row (failed, batches): what a fetch has to report. More failed batches than tolerated are an error."""
    told = replies.where("error IS NOT NULL").agg(F.count("*").alias("failed"), F.array_sort(F.collect_set("batch")).alias("batches"))
    too_many = F.raise_error(F.concat(F.lit("failed batches: "), F.col("failed").cast("string")))
    return told.withColumn("failed", F.when(F.col("failed") <= tolerated, F.col("failed")).otherwise(too_many.cast("long")))
