"""Line dedup: overlapping windows of three lines.

Lines are what line feeds divide. Windows of three consecutive lines of a text
are hashed; the first occurrence of a window, by doc_id and then by line, is
kept, and the lines that any later occurrence covers are removed. Windows of
three empty lines do not count, nor do texts of fewer than three lines.

Defined cases: a very long text is a block of its own, with all its lines; a null
text stays null and has no lines; an empty text is one
empty line; among rows of equal id the order is that of the blocks in which they
were read; a null id comes first. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import batch, frames, pack, pack_sorted, unframe, unpack, unpack_sorted
from .exchange import ask, block_table, by_key, finish, from_planes, planes, shard_parts

WINDOW = 3
_NO_ID = -(1 << 63)


class _Lines:
    def __init__(self, docs: pa.RecordBatch) -> None:
        raw, at = B.buffers(docs.column("text"))
        data = np.insert(raw, at[1:], 10)
        self.end = np.flatnonzero(data == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        self.data = data
        self.doc = np.searchsorted(self.end, np.append(at[:-1] + np.arange(len(at) - 1), len(data)))
        lines = B.Words(data, self.start, self.end, self.doc)
        owner = lines.owner()
        keys, where = B.ngrams(lines.hashes(), owner, WINDOW)
        long = self.end - self.start
        some = sum(long[where + k] for k in range(WINDOW)) > 0
        self.key, self.at = keys[some], where[some]
        ids = docs.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.id = ids[owner[self.at]]
        # By key, then by id, then by place: the first of each key is the block's first occurrence.
        self.order = np.lexsort((self.at, self.id, self.key))
        k = self.key[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _request(docs: pa.RecordBatch, shards: int) -> dict[int, bytes]:
    lines = _Lines(docs)
    firsts = lines.order[lines.first]
    keys, ids = lines.key[firsts], lines.id[firsts]
    return {shard: frames([pack_sorted(keys[own]), pack(planes(ids[own]))]) for shard, (own,) in shard_parts(shards, keys)}


def _packed(bits: np.ndarray) -> bytes:
    """Bits behind their number."""
    return len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=4), count=int.from_bytes(raw[:4], "little"))


def _respond(own: dict[int, bytes]) -> tuple[dict[int, bytes], list[int]]:
    blocks = sorted(own)
    got = [unframe(own[b]) for b in blocks]
    keys = [unpack_sorted(p[0]) for p in got]
    ids = np.concatenate([from_planes(unpack(p[1])) for p in got])
    order, starts, lengths = by_key(keys)
    # Among equal keys the smallest id wins, then the first block: the sort is stable.
    least = np.minimum.reduceat(ids[order], starts)
    is_least = ids[order] == np.repeat(least, lengths)
    place = np.where(is_least, np.arange(len(order)), len(order))
    winner = np.zeros(len(order), bool)
    winner[order[np.minimum.reduceat(place, starts)]] = True
    return {b: _packed(w) for b, w in zip(blocks, np.split(winner, np.cumsum([len(k) for k in keys])[:-1]), strict=True)}, []


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _done(docs: pa.RecordBatch, replies: list[bytes], _: int) -> pa.RecordBatch:
    lines = _Lines(docs)
    firsts = lines.order[lines.first]
    first_here = np.concatenate([np.zeros(0, np.uint8), *map(_unpacked, replies)]).astype(bool)
    later = np.ones(len(lines.key), bool)
    later[firsts[first_here]] = False
    gone = np.zeros(len(lines.start), bool)
    for k in range(WINDOW):
        gone[lines.at[later] + k] = True
    removed = np.add.reduceat(gone.astype(np.int64), lines.doc[:-1]) if docs.num_rows else np.zeros(0, np.int64)
    texts = docs.column("text").to_pylist()
    for d in np.flatnonzero(removed):
        a, b = lines.doc[d], lines.doc[d + 1]
        texts[d] = b"\n".join(lines.data[lines.start[i] : lines.end[i]].tobytes() for i in range(a, b) if not gone[i]).decode()
    counts = np.where(docs.column("text").is_null().to_numpy(zero_copy_only=False), 0, np.diff(lines.doc))
    own = batch(_SCHEMA, docs.column("doc_id"), counts, removed, texts)
    more = [n for n in docs.schema.names if n.startswith("keep")]
    return pa.RecordBatch.from_arrays([*own.columns, *(docs.column(n) for n in more)], names=[*own.schema.names, *more])


_SQL = "doc_id long, n_lines long, n_removed long, text string"


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed, the text of the lines that stay, and columns to keep as keep0, keep1, ..."""
    blocks = block_table(docs, "line-blocks", keep)
    more = "".join(f", keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return finish(blocks, ask(blocks, _request, _respond, "line-firsts"), _done, _SQL + more)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without later occurrences; a text of which nothing stays goes as a whole."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = dedup_lines(docs, keep).where("n_removed = 0 OR text <> ''")
    return done.select(*(F.col(f"keep{keep.index(c)}").alias(c) if c in keep else F.col(c) for c in docs.columns))
