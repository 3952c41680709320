"""Token-id files: fixed-width bit packing with block offsets.

A file is a run of segments. A segment holds whole documents in ascending id
order: a fixed header, the document ids, where each document's tokens end, the
byte offset of each block, and the blocks. A block has BLOCK tokens, the last
may have fewer, each stored in the minimum bits of the vocabulary, high bit
first; it begins at a byte, so any token range is read by unpacking only the
blocks that it meets. Spark's own text writer puts each segment down as one
record behind which SEPARATOR stands, so that writing works, and is retried
safely, on every file system that Spark reaches; Spark's text reader cuts files
at separators, so files are split over tasks and no task holds more than a
segment of any file. A file has at most FILE_SEGMENTS segments.

Layout: header, big-endian: magic ``GTB2``, u32 bits, u32 block, u32 mask (added to
ids bit by bit; 0 unless the separator's bytes would occur), i64 shard, i64 before
(tokens of the shard in earlier segments), i64 docs, i64 tokens, i64 blocks; then
little-endian: i64 ids[docs]; i64 ends[docs]; i64 offsets[blocks + 1]; payload.

Shards are ranges of (doc_id, hash of the text), so that many rows of one id are
dealt to several; each is as large as SHARD_TEXT bytes of text, about.

Defined cases: a null or empty text has the end id only; repeated ids stand
next to each other, in the order of a hash of their texts; a null id sorts first
and is written as the smallest 64-bit integer; a very long text is a segment of
its own, together with what was begun before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .common import PARTITIONS, batch, documents, map_arrow, new_path, shards_for
from .encoding import ENCODED_BYTES, Encoder, broadcast_tokenizer, crc, with_end

MAGIC = b"GTB2"
BLOCK = 4096
SEGMENT_TOKENS = 2 << 20
#: A segment of two-byte ids takes 4 MB, so files stay below 256 MB.
FILE_SEGMENTS = 56
#: Bytes of text for which the files get one more shard, up to PARTITIONS; a task writes segment after segment, so a shard's size does not matter to it.
SHARD_TEXT = 32 << 20
SEPARATOR = "\n--end of segment 5f1c0d83b7a94e26--\n"
_HEADER = struct.Struct(">4sIIIqqqqq")
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in bits each, high bit first, filled up to a byte at the end."""
    wide = np.ascontiguousarray(ids, dtype=">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return wide[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :].reshape(-1)).tobytes()


def unpack_bits(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    wide = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        wide[:, 4 - bits // 8 :] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        full = np.zeros((n, 32), np.uint8)
        full[:, 32 - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
        wide = np.packbits(full, axis=1)
    return wide.reshape(-1).view(">u4").astype(np.uint32)


class Segment:
    """A segment in memory, which unpacks only the blocks that are asked for."""

    def __init__(self, raw: bytes | pa.Buffer) -> None:
        whole = np.frombuffer(raw, np.uint8)
        magic, self.bits, self.block, self.mask, self.shard, self.before, docs, self.tokens, blocks = _HEADER.unpack_from(whole)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        longs = whole[_HEADER.size : _HEADER.size + 8 * (2 * docs + blocks + 1)].tobytes()
        table = np.frombuffer(longs, "<i8")
        self.ids, self.ends, self.offsets = table[:docs], table[docs : 2 * docs], table[2 * docs :]
        self.payload = whole[_HEADER.size + len(longs) :]

    def read(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b - 1 of the segment."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        parts = [unpack_bits(self.payload[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.tokens - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block] ^ np.uint32(self.mask)

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def segment(shard: int, before: int, ids: list[int], tokens: list[np.ndarray], bits: int, block: int = BLOCK, mask: int = 0) -> bytes:
    """The bytes of a segment, without the separator."""
    flat = (np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)) ^ np.uint32(mask)
    parts = [pack_bits(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    ends, offsets = np.cumsum([len(t) for t in tokens]), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    out = b"".join([_HEADER.pack(MAGIC, bits, block, mask, shard, before, len(ids), len(flat), len(parts)), np.array(ids, "<i8").tobytes(), ends.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), *parts])
    return out if SEPARATOR.encode() not in out else segment(shard, before, ids, tokens, bits, block, mask + 1)


def _writer(definition, end: int, bits: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Partitions are ranges in ascending order, so their numbers are the shards'.
        shard, encoder = TaskContext.get().partitionId(), None
        ids, tokens, size, before = [], [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(shard, before, ids, tokens, bits)], pa.binary())], names=["value"])

        for piece in B.chunks(batches, limit=ENCODED_BYTES):
            encoder = encoder or Encoder(definition.value)
            flat, at = with_end(*encoder.encode(piece.column("text")), end)
            for k, i in enumerate(piece.column("doc_id").to_pylist()):
                if size >= SEGMENT_TOKENS:
                    yield out()
                    ids, tokens, size, before = [], [], 0, before + size
                ids.append(NO_ID if i is None else i)
                tokens.append(flat[at[k] : at[k + 1]])
                size += int(at[k + 1] - at[k])
        if ids:
            yield out()

    return written


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str, shards: int | None = None, vocabulary: int | None = None) -> None:
    """Encodes all texts, appends the end id to each, and writes token-id files in ascending id order under path."""
    spark = docs.sparkSession
    rows = documents(docs)
    shards = shards or min(PARTITIONS, shards_for(rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0, SHARD_TEXT))
    definition = broadcast_tokenizer(spark, tokenizer)
    bits = bits_for(max(vocabulary or Encoder(definition.value).vocabulary, end + 1))
    # Equal rows come apart by where they were read, so that no single text or id makes a hot shard.
    order = [F.asc_nulls_first("doc_id"), "print", "place"]
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("print"), F.spark_partition_id().alias("place")).repartitionByRange(shards, *order).sortWithinPartitions(*order[:2], "text")
    written = map_arrow(dealt.select("doc_id", "text"), _writer(definition, end, bits), "value binary")
    # The text writer puts a string's bytes down as they are; the cast does not change them.
    written.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _header_long(at: int) -> Column:
    """A header's number from its place."""
    return F.conv(F.hex(F.substring("value", at + 1, 8)), 16, 10).cast("long")


def _reader(base: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("value"):
                s = Segment(raw.as_buffer())
                flat, ends = s.read(0, s.tokens), s.ends.tolist()
                begins = [0, *ends[:-1]]
                docs = pa.array([None if x == NO_ID else x for x in s.ids.tolist()], pa.int64())
                start = base[s.shard] + s.before + np.array(begins, np.int64)
                yield batch(_READ, docs, start, np.diff(s.ends, prepend=0), [crc(flat[a:z]) for a, z in zip(begins, ends, strict=True)])

    return read


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of token-id files, one a row (value); files are split over tasks between segments."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    found = segments(spark, path)
    # One number a shard: what stands before it is what earlier shards hold.
    totals = found.select(_header_long(16).alias("shard"), _header_long(40).alias("tokens")).groupBy("shard").agg(F.sum("tokens").alias("n")).collect()
    base, before = {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        base[r["shard"]], before = before, before + r["n"]
    return map_arrow(found, _reader(base), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end: int, path: str | None = None) -> DataFrame:
    """Writes the token-id files of all documents and returns what reading them back gives."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, end, path)
    return read_tokens(docs.sparkSession, path)
