"""Corpus-wide facts about hashed keys, for blocks of documents.

Documents are packed into blocks of bounded size. Each block sends the distinct
keys that occur in it, aggregated, to shards that divide the hash range evenly;
a shard holds all blocks' entries of its keys, works out what each block has to
know, and answers in the order in which the block sent them. Blocks then read
their documents again, next to the answers. A key of any frequency is one entry
per block, so no shard grows with a key's frequency; and there is one shard for
each SHARD_BYTES of text, so none grows with the input: what a task holds has
one size at any scale. A block sends nothing to shards of which it has no key, so
its messages, and the work of making them, are never more than its distinct keys,
however many shards there are. Beyond PARTITIONS shards a partition has several,
sorted, and works on one after the other: Spark keeps track of each partition for
each map task, which no driver could do for millions of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as B
from .common import PARTITIONS, batch, documents, drop, map_arrow, shards_for, shared_table

#: Bytes of text in a block; a longer single text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Rows of a block, which very short texts would otherwise fill; a batch from Spark has fewer.
BLOCK_ROWS = 1 << 20

_BLOCK = pa.schema([("block", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())])
_MESSAGE = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("totals", pa.list_(pa.int64()))])
_MESSAGE_SQL = "shard int, block long, payload binary, totals array<long>"
#: The block number of a shard's totals.
TO_ALL = -1
_OWN = -1

#: Makes a block's messages by shard, of its documents and the number of shards.
Request = Callable[[pa.RecordBatch, int], dict[int, bytes]]
Respond = Callable[[dict[int, bytes]], tuple[dict[int, bytes], list[int]]]
#: Makes a block's rows of its documents, its answers in the order of their shards, and its number.
Finish = Callable[[pa.RecordBatch, list[bytes], int], pa.RecordBatch]


def _packed(pieces: list[pa.RecordBatch]) -> bytes:
    whole = pa.Table.from_batches(pieces).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(whole)
    return sink.getvalue().to_pybytes()


def _documents_of(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, made, pieces, size, held = TaskContext.get().partitionId() << 20, 0, [], 0, 0

    def out() -> pa.RecordBatch:
        return batch(_BLOCK, [first + made], [sum(p.num_rows for p in pieces)], [size], [_packed(pieces)])

    for piece in B.chunks(batches, limit=BLOCK_BYTES):
        n = len(B.buffers(piece.column("text"))[0])
        if pieces and (size + n > BLOCK_BYTES or held + piece.num_rows > BLOCK_ROWS):
            yield out()
            made, pieces, size, held = made + 1, [], 0, 0
        pieces.append(piece)
        size, held = size + n, held + piece.num_rows
    if pieces:
        yield out()


@dataclass
class Blocks:
    """Documents in blocks (block, n_docs, n_bytes, payload), in the shared folder."""

    table: DataFrame
    n_docs: int
    shards: int
    #: Blocks that a partition made, on average, rounded up: their numbers spread evenly over the partitions.
    stride: int

    @property
    def partitions(self) -> int:
        return min(self.shards, PARTITIONS)

    def drop(self) -> None:
        drop(self.table)


def block_table(docs: DataFrame, label: str, keep: tuple[str, ...] = ()) -> Blocks:
    """Documents in blocks; columns of keep travel along as keep0, keep1, ..."""
    rows = documents(docs) if not keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)))
    table = shared_table(map_arrow(rows, _blocks, "block long, n_docs long, n_bytes long, payload binary"), label)
    sums = table.agg(F.sum("n_docs").alias("d"), F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.max(F.shiftright("block", 20)).alias("p")).first()
    return Blocks(table, sums["d"] or 0, shards_for(sums["b"] or 0), -(-sums["n"] // ((sums["p"] or 0) + 1)) or 1)


def shard_parts(shards: int, *keys: np.ndarray) -> list[tuple[int, list[slice]]]:
    """The shards that keys fall to, in ascending order, each with its part of every one of the sorted arrays."""
    of = [(k >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) for k in keys]
    some = np.unique(np.concatenate(of))
    parts = [map(slice, np.searchsorted(o, some).tolist(), np.searchsorted(o, some, "right").tolist()) for o in of]
    return [(shard, list(own)) for shard, *own in zip(some.tolist(), *parts, strict=True)]


def ask(blocks: Blocks, request: Request, respond: Respond, label: str) -> DataFrame:
    """The answers of all shards (shard, block, payload, totals), written to the shared folder; block TO_ALL holds a shard's totals."""
    n = blocks.shards

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("payload"), strict=True):
                parts = request(_documents_of(payload.as_py()), n)
                if parts:
                    yield batch(_MESSAGE, list(parts), [block] * len(parts), list(parts.values()), [None] * len(parts))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}

        def answered() -> pa.RecordBatch:
            replies, totals = respond(own)
            k = len(replies)
            return batch(_MESSAGE, [at] * (k + 1), [*replies, TO_ALL], [*replies.values(), None], [*([None] * k), totals])

        for b in batches:
            for shard, block, payload in zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if shard != at and own:
                    yield answered()
                    own = {}
                at = shard
                own[block] = payload
        if own:
            yield answered()

    # Sorted, so that a task that has several shards works on one after the other.
    home = F.expr(f"cast(shard * {blocks.partitions}L div {n} as int)")
    asked = map_arrow(blocks.table.select("block", "payload"), requests, _MESSAGE_SQL).repartitionById(blocks.partitions, home).sortWithinPartitions("shard", "block")
    return shared_table(map_arrow(asked, answers, _MESSAGE_SQL), label)


def totals(answers: DataFrame, width: int) -> list[int]:
    """The sums over all shards of what each said in total."""
    told = answers.where(F.col("block") == TO_ALL)
    sums = told.agg(*(F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(width))).first()
    return [x or 0 for x in sums]


def finish(blocks: Blocks, answers: DataFrame, done: Finish, schema: str) -> DataFrame:
    """Blocks with their answers, by shard; done() makes a block's rows of them."""

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, replies = None, None, []
        for b in batches:
            for shard, block, payload in zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), b.column("payload"), strict=True):
                if shard == _OWN:
                    if docs is not None:
                        yield done(docs, replies, at)
                    at, docs, replies = block, _documents_of(payload.as_py()), []
                else:
                    assert block == at
                    replies.append(payload.as_py())
        if docs is not None:
            yield done(docs, replies, at)

    own = blocks.table.select(F.lit(_OWN).alias("shard"), "block", "payload")
    home = F.pmod(F.shiftright("block", 20) * blocks.stride + F.col("block").bitwiseAND((1 << 20) - 1), F.lit(blocks.partitions)).cast("int")
    both = own.unionByName(answers.where(F.col("block") != TO_ALL).select("shard", "block", "payload")).repartitionById(blocks.partitions, home).sortWithinPartitions("block", "shard")
    return map_arrow(both, finished, schema)


def row_numbers(block: int, n: int) -> np.ndarray:
    """A number for each document row of a block, of its own in the whole table."""
    return (block << 22) + np.arange(n)


def kept_rows(blocks: Blocks, rows: DataFrame, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The documents of the blocks whose row numbers (row) are given, once each, with the columns of docs."""
    own = rows.groupBy(F.shiftright("row", 22).alias("block")).agg(F.collect_list(F.col("row").bitwiseAND((1 << 22) - 1).cast("int")).alias("at"))
    columns = list(docs.columns)
    names = [f"keep{keep.index(c)}" if c in keep else c for c in columns]
    schema = T.StructType([T.StructField(c, {"doc_id": T.LongType(), "text": T.StringType()}.get(c, docs.schema[c].dataType)) for c in docs.columns])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, at in zip(b.column("payload"), b.column("at").to_pylist(), strict=True):
                piece = _documents_of(payload.as_py()).take(pa.array(sorted(at), pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names], names=columns)

    done = map_arrow(blocks.table.select("block", "payload").join(own, "block").select("payload", "at"), kept, schema)
    return done.select(*(F.col(f"`{c}`").cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def by_key(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts all blocks' keys (earlier blocks first among equals), where runs of equal keys begin, and run lengths."""
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    s = every[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(s)))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each block's entries with the counts of all blocks, and the counts of the distinct keys."""
    order, starts, lengths = by_key(keys)
    if not len(starts):
        return [np.zeros(0, np.int64) for _ in keys], np.zeros(0, np.int64)
    total = np.add.reduceat(np.concatenate(counts)[order], starts)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(total, lengths)
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1]), total


def planes(numbers: np.ndarray) -> np.ndarray:
    """64-bit numbers, one byte plane after the other."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1) if raw else np.zeros(0, np.int64)
