"""What the operators share: the shared folder, tables written to it, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Where each table of shared_table() lies, as long as its DataFrame is in use.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a folder of this process; on a cluster a machine's
    own folder would lose the other machines' parts, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="glossa-shared-")
    return _OWN["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    """A new place in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/glossa/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: lineage ends there, and lost executors cost nothing. compression: other than the session's."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def place_of(table: DataFrame) -> str:
    """Where a table of shared_table() lies: another session can read it there."""
    return _PLACES[table]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of shared_table() that nothing reads any more: whatever was made of them is written."""
    for t in tables:
        if path := _PLACES.pop(t, None):
            _delete(t.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application still has in the shared folder, once its results have been used."""
    _delete(spark, f"{shared_dir(spark)}/glossa/{spark.sparkContext.applicationId}")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package; on other clusters it is given with --py-files.

    Batches to Python are cut at 8 MB where the session leaves Spark's 64 MB: both sides hold a batch in memory.
    """
    if spark.conf.get(_BATCH_BYTES) in ("67108864b", "67108864"):
        spark.conf.set(_BATCH_BYTES, "8m")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def release_memory() -> None:
    """Gives what Python and Arrow no longer use back to the system; workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library other than glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow, with the worker's memory released at a task's end."""
    ship(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release_memory()

    return df.mapInArrow(released, schema)


#: Bytes of text for which a shuffle of texts or of their keys gets one more shard.
SHARD_BYTES = 12 << 20
#: Partitions of such a shuffle, at most: Spark's driver keeps track of each one for each map task. Beyond, one has several shards, or more of a sorted range.
PARTITIONS = 20_000


def shards_for(n_bytes: int, size: int = SHARD_BYTES) -> int:
    """Shards for so many bytes of text, so that each stays of one size however large the input is."""
    return max(1, -(-n_bytes // size))


def documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns that the operators read, under their usual names, whatever else the input has."""
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def id_crc(ids: pa.Array) -> np.ndarray:
    """crc32 of each id as text; a null id counts as empty text."""
    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()), np.int64, len(ids))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(raw: bytes | np.ndarray) -> bytes:
    """Compressed bytes behind their length."""
    raw = raw.tobytes() if isinstance(raw, np.ndarray) else raw
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return _ZSTD.decompress(blob[8:], decompressed_size=n, asbytes=True) if n else b""


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, one byte plane after the other, compressed."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pack(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(unpack(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64) if len(raw) else np.zeros(0, np.uint64)


def frames(parts: list[bytes]) -> bytes:
    """Several byte strings in one."""
    return b"".join([len(parts).to_bytes(4, "little"), *(len(p).to_bytes(8, "little") for p in parts), *parts])


def unframe(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    sizes, at, out = [int.from_bytes(blob[4 + 8 * i : 12 + 8 * i], "little") for i in range(n)], 4 + 8 * n, []
    for size in sizes:
        out.append(blob[at : at + size])
        at += size
    return out
