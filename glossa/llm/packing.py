"""Best-fit packing: bounded-space online best-fit of token pieces into sequences of fixed length.

Each partition packs its pieces as they come, those of one chunk of text longest
first. Open bins are kept in a bitset
keyed by free space: the lowest set bit at or above a piece's length is the
tightest bin. When OPEN bins are open and a piece fits none, the fullest closes.
The bins still open at a partition's end are packed once more, as items, over
groups of partitions, so that a partition leaves no row of half-empty sequences.

Defined cases: a null or empty text is its end id; a text longer than a sequence
is cut into full pieces and a rest; rows are kept one for one, repeated ids too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import batch, documents, map_arrow, shared_table
from .encoding import ENCODED_BYTES, Encoder, broadcast_tokenizer, crc, with_end

SEQUENCE = 2048
OPEN = 2048
#: Partitions whose open bins are packed together.
MERGED = 64


class BestFit:
    """Open bins by free space: a bitset of the amounts that some bin has, and the bins of each amount."""

    def __init__(self, size: int = SEQUENCE, most_open: int = OPEN) -> None:
        self.size, self.most_open, self.made, self.count = size, most_open, 0, 0
        self.free, self.bins = 0, [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        b = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.count -= 1
        return b

    def _open(self, b: int, space: int) -> None:
        self.bins[space].append(b)
        self.free |= 1 << space
        self.count += 1

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for an item."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            b = self._take(space)
        else:
            if self.count >= self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
            b, space = self.made, self.size
            self.made += 1
        if space > length:
            self._open(b, space - length)
        return b, self.size - space

    def still_open(self) -> dict[int, int]:
        """Free space of each open bin."""
        return {b: space for space, own in enumerate(self.bins) for b in own}


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _packer(definition, end: int, size: int, most_open: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        fit, waiting, encoder = BestFit(size, most_open), {}, None

        def out(rows: list[tuple], fill: int) -> Iterator[tuple]:
            return ((*r[:5], first + r[5], r[6], fill) for r in rows)

        for piece in B.chunks(batches, limit=ENCODED_BYTES):
            encoder = encoder or Encoder(definition.value)
            ids, at = with_end(*encoder.encode(piece.column("text")), end)
            done: list[tuple] = []
            pieces = [(min(b - s, size), doc, k, s, s - a) for doc, a, b in zip(piece.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True) for k, s in enumerate(range(a, b, size))]
            # What comes at once goes longest first: short pieces then fill what long ones leave.
            for n, doc, k, s, start in sorted(pieces, key=lambda p: -p[0]):
                bin_, offset = fit.place(n)
                waiting.setdefault(bin_, []).append((doc, k, start, n, crc(ids[s : s + n]), bin_, offset))
                if offset + n == size:
                    done.extend(out(waiting.pop(bin_), -1))
            still = fit.still_open()
            for b in [b for b in waiting if b not in still]:
                done.extend(out(waiting.pop(b), -1))
            if done:
                yield batch(_PIECES, *map(list, zip(*done, strict=True)))
        rest = [r for b, space in fit.still_open().items() for r in out(waiting[b], size - space)]
        if rest:
            yield batch(_PIECES, *map(list, zip(*rest, strict=True)))

    return packed


_MOVED = pa.schema([("bin", pa.int64()), ("sequence_id", pa.int64()), ("shift", pa.int64())])


def _merger(size: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Fullest first; at most MERGED * OPEN rows, so nothing needs to close.
        rows = sorted(((f, b) for x in batches for b, f in zip(x.column("bin").to_pylist(), x.column("fill").to_pylist(), strict=True)), reverse=True)
        fit, names, out = BestFit(size, len(rows) + 1), {}, []
        for fill, b in rows:
            k, offset = fit.place(fill)
            out.append((b, names.setdefault(k, b), offset))
        if out:
            yield batch(_MOVED, *map(list, zip(*out, strict=True)))

    return merged


def best_fit_pack(docs: DataFrame, tokenizer: str, end: int, size: int = SEQUENCE, most_open: int = OPEN) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = shared_table(map_arrow(documents(docs), _packer(broadcast_tokenizer(spark, tokenizer), end, size, most_open), _PIECES_SQL), "pieces")
    left = pieces.where("fill >= 0").select("bin", "fill").distinct()
    group = (F.shiftright("bin", 36) / MERGED).cast("int")
    groups = (pieces.agg(F.max(F.shiftright("bin", 36)).alias("m")).first()["m"] or 0) // MERGED + 1
    moved = map_arrow(left.repartitionById(groups, group), _merger(size), "bin long, sequence_id long, shift long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.where("fill < 0").withColumn("sequence_id", F.col("bin")).select(columns)
    return full.unionByName(pieces.where("fill >= 0").join(moved, "bin").withColumn("offset", F.col("offset") + F.col("shift")).select(columns))
