"""Benchmark decontamination: a broadcast set of hashed benchmark n-grams, a scan of document windows, and a check of each hit on the words themselves.

Executors make the benchmark's windows, in blocks of at most BLOCK_BYTES of text
(or one longer text): sorted arrays of hashes, places in one buffer of words, and
items, about six bytes for each byte of text. Blocks are broadcast one after the
other, so that what a worker or the driver holds has a fixed bound however large
the benchmark is. A benchmark of one block, which all known ones are, makes a
map-only scan; of more, each block's hits are written before the next block is
broadcast, and are joined by document row.

Defined cases: null and wordless texts have no words and no hits; a benchmark
text without words gives no window; rows are kept one for one, repeated ids
included; a benchmark row without id can cause hits but is not listed; very long
texts are scanned whole, in a step of their own.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import batch, documents, map_arrow, shared_table

WINDOW = 10
#: Most bytes of benchmark text whose windows are broadcast at once.
BLOCK_BYTES = 8 << 20

_SPANS = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


@dataclass
class _Windows:
    """Windows of one length: sorted hashes, where each one's words are, and its items (from first to the next one's first)."""

    key: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    item: np.ndarray
    near: np.ndarray


class WindowSet:
    """Windows of benchmark texts by hash, for each length that occurs: window words long, or a whole shorter text."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW) -> None:
        words = B.scan(pa.array(texts, pa.string()))
        h, counts, owner = words.hashes(), words.counts(), words.owner()
        self.ids = [None if i is None else str(i) for i in ids]
        self.data = words.data
        self.by_length: dict[int, _Windows] = {}
        for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            # Texts of fewer words than the window are one window each.
            key, at = B.ngrams(h, owner, n)
            own = np.flatnonzero(np.minimum(counts, window)[owner[at]] == n)
            key, at = key[own], at[own]
            start, end, item = words.start[at], words.end[at + n - 1], owner[at]
            # Equal texts stand together: equal hashes do, and where one hash has two texts these are sorted.
            order = np.lexsort((item, key))
            order = self._apart(order, key, start, end)
            key, start, end, item = key[order], start[order], end[order], item[order]
            same = np.zeros(len(key), bool)
            for k in (np.flatnonzero(key[1:] == key[:-1]) + 1).tolist():
                same[k] = self._words(start[k], end[k]) == self._words(start[k - 1], end[k - 1])
            first = np.flatnonzero(~same)
            near = np.zeros(1 << 20, bool)
            near[key >> np.uint64(44)] = True
            self.by_length[n] = _Windows(key[first], start[first].astype(np.int32), end[first].astype(np.int32), np.append(first, len(key)).astype(np.int32), item.astype(np.int32), near)

    def _words(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()

    def _apart(self, order: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sorts the windows of one hash by their words, where these differ."""
        k = key[order]
        bounds = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        for a, b in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist(), strict=True):
            texts = [self._words(start[i], end[i]) for i in order[a:b]]
            if len(set(texts)) > 1:
                order[a:b] = [i for _, i in sorted(zip(texts, order[a:b].tolist(), strict=True))]
        return order

    def hits(self, words: B.Words) -> Iterator[tuple[int, int, list[int]]]:
        """First word, end word and items (by number) of each window that occurs, verified word by word."""
        h, owner = words.hashes(), words.owner()
        for n, w in self.by_length.items():
            g, at = B.ngrams(h, owner, n)
            likely = np.flatnonzero(w.near[g >> np.uint64(44)])
            g, at = g[likely], at[likely]
            low, high = np.searchsorted(w.key, g), np.searchsorted(w.key, g, "right")
            for k in np.flatnonzero(high > low).tolist():
                a = int(at[k])
                said = words.text(a, a + n)
                for j in range(int(low[k]), int(high[k])):
                    if self._words(w.start[j], w.end[j]) == said:
                        yield a, a + n, w.item[w.first[j] : w.first[j + 1]].tolist()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans_of(words: B.Words, known: WindowSet) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set]]:
    """Merged spans and item ids of the texts that have any."""
    spans, items, owner = defaultdict(list), defaultdict(set), words.owner()
    for a, b, own in known.hits(words):
        d = int(owner[a])
        spans[d].append((a - int(words.doc[d]), b - int(words.doc[d])))
        items[d].update(own)
    return {d: _merged(own) for d, own in spans.items()}, {d: {known.ids[i] for i in own} for d, own in items.items()}


def _scanner(windows):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for piece in B.chunks(batches):
            words = B.scan(piece.column("text"))
            spans, items = _spans_of(words, known)
            merged = [spans.get(d, []) for d in range(piece.num_rows)]
            yield batch(_FOUND, piece.column("row"), piece.column("doc_id"), words.counts(), [[a for a, _ in m] for m in merged], [[b for _, b in m] for m in merged], [sorted(items[d] - {None}) if d in items else [] for d in range(piece.num_rows)])

    return scanned


def _made(window: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(WindowSet(ids, texts, window))], pa.binary())], names=["windows"])

        for b in batches:
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n = len((t or "").encode())
                if texts and size + n > BLOCK_BYTES:
                    yield out()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t or "")
                size += n
        if ids:
            yield out()

    return made


def _blocks(benchmark: DataFrame, window: int) -> DataFrame:
    """The benchmark's windows in blocks of bounded size, one a row, in the shared folder."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return shared_table(map_arrow(rows.repartition(max(1, -(-n // BLOCK_BYTES))), _made(window), "windows binary"), "windows")


def _each(blocks: DataFrame) -> Iterator[WindowSet]:
    """One block after the other, each a partition of its own on the way to the driver."""
    for r in blocks.toLocalIterator():
        yield pickle.loads(r["windows"])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, merged word spans (starts, ends) that benchmark windows cover, and the ids of the items found."""
    blocks = _blocks(benchmark, window)
    if blocks.count() <= 1:
        return map_arrow(documents(docs).withColumn("row", F.lit(0).cast("long")), _scanner(_broadcast(docs, blocks, window)), _SPANS).drop("row")
    return _spans(shared_table(documents(docs).withColumn("row", F.monotonically_increasing_id()), "rows"), blocks).drop("row")


def _broadcast(docs: DataFrame, blocks: DataFrame, window: int):
    return docs.sparkSession.sparkContext.broadcast(next(_each(blocks), None) or WindowSet([], [], window))


def _spans(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits of several blocks, joined by row."""
    found = []
    for block in _each(blocks):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        found.append(shared_table(map_arrow(rows, _scanner(shared), _SPANS), "spans"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return map_arrow(every.select("row", "doc_id", "n_words", "spans.starts", "spans.ends", "items"), _remerge, _SPANS)


def _remerge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        merged = [_merged(list(zip(s, e, strict=True))) for s, e in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True)]
        yield batch(_FOUND, b.column("row"), b.column("doc_id"), b.column("n_words"), [[x for x, _ in m] for m in merged], [[x for _, x in m] for m in merged], b.column("items"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the characters from each span's first word to its last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], B.ALNUM[raw], [False]])
    s, e = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        keep[s[a] : e[b - 1]] = False
    return raw[keep].tobytes().decode()


def _cleaned(piece: pa.RecordBatch, spans: dict[int, list[tuple[int, int]]], words: np.ndarray, drop_share: float) -> pa.RecordBatch:
    if not spans:
        return piece
    at = piece.schema.get_field_index("text")
    texts, stays = piece.column(at).to_pylist(), np.ones(piece.num_rows, bool)
    for d, own in spans.items():
        stays[d] = sum(b - a for a, b in own) <= drop_share * words[d]
        if stays[d]:
            texts[d] = _cut(texts[d], own)
    return piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.schema.field(at).type)).filter(pa.array(stays))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5) -> DataFrame:
    """The documents, with all their columns, without benchmark passages.

    The characters from a span's first word to its last go. A document of which
    more than drop_share of the words is covered goes as a whole.
    """
    blocks = _blocks(benchmark, window)
    if blocks.count() <= 1:
        windows = _broadcast(docs, blocks, window)

        def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in B.chunks(batches):
                words = B.scan(piece.column("text"))
                yield _cleaned(piece, _spans_of(words, windows.value)[0], words.counts(), drop_share)

        return map_arrow(docs, cleaned, docs.schema)
    # The documents' own columns travel in a struct, so that none of them meets a name used here.
    rows = shared_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    spans = _spans(rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"), "row"), blocks)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = {d: list(zip(x, y, strict=True)) for d, (x, y) in enumerate(zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True)) if x}
            yield _cleaned(pa.RecordBatch.from_struct_array(b.column("doc")), spans, b.column("n_words").to_numpy(), drop_share)

    return map_arrow(rows.join(spans.select("row", "n_words", "starts", "ends"), "row"), joined, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query contract from contaminated_spans()."""
    hit = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (s, x) -> s + x)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )

