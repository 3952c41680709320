"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Words are those of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased; a shingle is
five consecutive words (all words of a shorter text). A shingle weighs its count
in the text times 1 + IDF_SHARE * (1 - log2(df) / log2(N + 1)), the logarithm of
the document frequency rounded down. The weight stays within 1 and
1 + IDF_SHARE, so that the members of a group of copies, whose shared shingles
are frequent for that very reason, are not driven apart by the few words in
which they differ.

Document frequencies count all documents and come through exchange. A text whose
shingles found elsewhere make up less than the threshold of its weight cannot be
similar to any other, and gets no signature: that filter loses nothing. Others
get SAMPLES consistent samples in bands of ROWS. Texts of equal word sequences
are one class from the start. In each bucket every member is compared with the
one that shares the largest buckets, the likeliest origin of the others; members
unlike it are compared with all others of the bucket, a chunk pair at a time, by
exact matrix products that send on a spanning forest of the links, never pairs.
Chunks are bounded in documents and in shingles. Links are joined to components.
Similarities are taken in double precision over 64-bit shingle hashes.

Rows are told apart by their place, not by doc_id. The rows of a large class of
equal texts meet the class's first row in a join whose hot keys adaptive
execution splits (spark.sql.adaptive.skewJoin, on by default).

Defined cases: texts without words (null, empty, punctuation) are alike to
nothing, each its own class; rows that share a doc_id are rows of their own,
with the class of their text; a class is named by its smallest id, null ids
coming last; a very long text makes a block and, if need be, a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import batch, drop, frames, map_arrow, pack, pack_sorted, shared_table, unframe, unpack, unpack_sorted
from .exchange import Blocks, ask, block_table, finish, from_planes, kept_rows, planes, row_numbers, shard_parts, summed
from .graph import components, forest

SHINGLE = 5
THRESHOLD = 0.8
IDF_SHARE = 0.25
SAMPLES, ROWS = 64, 4
#: Documents and shingles of a bucket that one comparison takes at once, about, and columns of its matrices.
CHUNK, CHUNK_SHINGLES, SLAB = 1024, 1 << 19, 4096
#: Below the threshold by what sums in double precision may err.
_SLACK = 1e-9


class _Shingles:
    """Distinct shingles of each text of a block, by text and key, with their counts."""

    def __init__(self, docs: pa.RecordBatch) -> None:
        words = B.scan(docs.column("text"))
        h, counts = words.hashes(), words.counts()
        self.n_words = counts
        some = np.flatnonzero(counts)
        self.print = np.zeros((2, docs.num_rows), np.uint64)
        if len(h):
            place = B.ragged(counts)
            powers = B._powers(int(counts.max()))
            for seed in (0, 1):
                self.print[seed][some] = B.mix(np.add.reduceat((h if seed == 0 else words.hashes(1)) * powers[place], words.doc[some]) + counts[some].astype(np.uint64))
        keys, at = B.ngrams(h, words.owner(), SHINGLE)
        owner = words.owner()[at] if len(at) else np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        keys = np.concatenate([keys, self.print[0][short]])
        owner = np.concatenate([owner, short])
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.key, self.owner = keys[first], owner[first]
        self.count = np.diff(np.append(first, len(keys)))


def _request(docs: pa.RecordBatch, shards: int) -> dict[int, bytes]:
    keys, df = np.unique(_Shingles(docs).key, return_counts=True)
    return {shard: frames([pack_sorted(keys[own]), pack(planes(df[own]))]) for shard, (own,) in shard_parts(shards, keys)}


def _respond(own: dict[int, bytes]) -> tuple[dict[int, bytes], list[int]]:
    got = [unframe(p) for p in own.values()]
    each, _ = summed([unpack_sorted(p[0]) for p in got], [from_planes(unpack(p[1])) for p in got])
    return {b: pack(np.log2(df).astype(np.uint8)) for b, df in zip(own, each, strict=True)}, []


def _uniform(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of (0, 1) from each hash."""
    return ((h >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32, ((h & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2**32


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """n consistent weighted samples (hashes of shingle and level) of each set; set i begins at starts[i]."""
    out = np.empty((len(starts), n), np.uint64)
    lengths = np.diff(np.append(starts, len(keys)))
    log_w = np.log(weights)
    for k in range(n):
        h = B.mix(keys + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        u1, u2 = _uniform(h)
        h = B.mix(h)
        u3, u4 = _uniform(h)
        r = -np.log(u1 * u2)
        beta, _ = _uniform(B.mix(h))
        t = np.floor(log_w / r + beta)
        log_a = np.log(-np.log(u3 * u4)) - r * (t - beta) - r
        least = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), lengths))
        place = least[np.searchsorted(least, starts)]
        out[:, k] = B.mix(keys[place] + t[place].astype(np.int64).astype(np.uint64))
    return out


def band_keys(sampled: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's samples."""
    n, k = sampled.shape
    out = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows)).copy()
    for r in range(rows):
        out = B.mix(out * np.uint64(0xD6E8FEB86659FD93) + sampled[:, r::rows])
    return out.view(np.int64)


_SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()), ("bands", pa.list_(pa.int64())), ("size", pa.int64()), ("vector", pa.binary())])
_SIGNED_SQL = "row long, doc_id long, h1 long, h2 long, n_words long, bands array<long>, size long, vector binary"


def weights_of(counts: np.ndarray, codes: np.ndarray, scale: float) -> np.ndarray:
    """Weights of shingles from their counts in a text and their document frequencies' rounded logarithms."""
    return counts * (1 + IDF_SHARE * (1 - np.minimum(1, codes / scale)))


def _signer(scale: float):
    def done(docs: pa.RecordBatch, replies: list[bytes], block: int) -> pa.RecordBatch:
        s, n = _Shingles(docs), docs.num_rows
        keys, which = np.unique(s.key, return_inverse=True)
        codes = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(unpack(r), np.uint8) for r in replies)])
        assert len(codes) == len(keys)
        code = codes[which]
        weight = weights_of(s.count, code, scale)
        shared, whole = np.bincount(s.owner, weight * (code > 0), n), np.bincount(s.owner, weight, n)
        likely = (whole > 0) & (shared >= THRESHOLD * whole - _SLACK)
        chosen = likely[s.owner]
        key, count, code, w, owner = s.key[chosen], s.count[chosen], code[chosen], weight[chosen], s.owner[chosen]
        ids = np.flatnonzero(likely)
        bands, sizes, vectors = [None] * n, [None] * n, [None] * n
        if len(ids):
            starts = np.searchsorted(owner, ids)
            hashed = band_keys(samples(key, w, starts))
            for d, a, b, own in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(key)], hashed, strict=True):
                bands[d], sizes[d], vectors[d] = own, b - a, vector(key[a:b], count[a:b], code[a:b])
        return batch(_SIGNED, row_numbers(block, n), docs.column("doc_id"), s.print[0].view(np.int64), s.print[1].view(np.int64), s.n_words, pa.array(bands, pa.list_(pa.int64())), sizes, pa.array(vectors, pa.binary()))

    return done


def vector(keys: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    """A weighted set: sorted keys, and what their weights come from."""
    return frames([keys.astype("<u8").tobytes(), pack(counts.astype("<u4")), pack(codes.astype(np.uint8))])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of the smaller weights over the sum of the larger ones."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    k, w = keys[order], np.concatenate([a[1], b[1]])[order].astype(np.float64)
    twin = np.flatnonzero(k[1:] == k[:-1])
    both = float(np.minimum(w[twin], w[twin + 1]).sum())
    return both / (float(w.sum()) - both)


def _weighted(blob: bytes, scale: float) -> tuple[np.ndarray, np.ndarray]:
    keys, counts, codes = unframe(blob)
    return np.frombuffer(keys, "<u8"), weights_of(np.frombuffer(unpack(counts), "<u4"), np.frombuffer(unpack(codes), np.uint8), scale)


_JUDGED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("alike", pa.bool_())])


def _judge(scale: float):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for b in batches:
            alike = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                y = y.as_py()
                if y != last:
                    last, other = y, _weighted(y, scale)
                alike.append(similarity(_weighted(x.as_py(), scale), other) >= THRESHOLD - _SLACK)
            yield batch(_JUDGED, b.column("u"), b.column("v"), alike)

    return judged


class _Block:
    """Probes and members of one chunk pair of a bucket: exact similarities by matrix products."""

    def __init__(self, scale: float) -> None:
        self.scale, self.rows = scale, ([], [])

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links between probes and members."""
        probes, members = self.rows
        if not probes or not members:
            return []
        ids = np.array([u for u, _ in probes + members], np.int64)
        sets = [_weighted(v, self.scale) for _, v in probes + members]
        sizes = np.array([len(k) for k, _ in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        key, weight = (np.concatenate([x[k] for x in sets]) for k in (0, 1))
        total = np.bincount(row, weight, len(sets))
        # One column for each weight that a shingle takes: the lesser of two weights is the sum of the steps that both reach.
        order = np.lexsort((weight, key))
        k, w, r = key[order], weight[order], row[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new = new_key | np.concatenate([[True], w[1:] != w[:-1]])
        column = np.cumsum(new) - 1
        first = column[new_key][np.cumsum(new_key) - 1]
        level = column - first
        at = np.flatnonzero(new)
        step = np.where(new_key[at], w[at], w[at] - np.concatenate([[0.0], w[at][:-1]]))
        r, c = np.repeat(r, level + 1), np.repeat(first, level + 1) + B.ragged(level + 1)
        n = len(probes)
        both = (np.bincount(c[r < n], minlength=len(step)) > 0) & (np.bincount(c[r >= n], minlength=len(step)) > 0)
        used = both[c]
        r, c = r[used], (np.cumsum(both) - 1)[c[used]]
        step = step[both]
        shared = np.zeros((n, len(members)))
        order = np.argsort(c, kind="stable")
        r, c = r[order], c[order]
        for a in range(0, len(step), SLAB):
            z = min(a + SLAB, len(step))
            lo, hi = np.searchsorted(c, [a, z])
            x = np.zeros((len(sets), z - a))
            x[r[lo:hi], c[lo:hi] - a] = 1
            shared += (x[:n] * step[a:z]) @ x[n:].T
        linked = shared >= (THRESHOLD - _SLACK) * (total[:n, None] + total[None, n:] - shared)
        linked &= ids[:n, None] != ids[None, n:]
        label = np.concatenate(forest(linked))
        return [(int(ids[i]), int(ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(label))) if ids[i] != ids[label[i]]]


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare(scale: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block(scale)
        for b in batches:
            for key, qc, mc, side, u, v in zip(*(b.column(c).to_pylist() for c in ("key", "qc", "mc", "side", "u", "vector")), strict=True):
                if (key, qc, mc) != at:
                    if found := block.links():
                        yield batch(_LINKS, [x for x, _ in found], [y for _, y in found])
                    at, block = (key, qc, mc), _Block(scale)
                block.rows[side].append((u, v))
        if found := block.links():
            yield batch(_LINKS, [x for x, _ in found], [y for _, y in found])

    return compared


def _chunks(n: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(size) / CHUNK_SHINGLES))


def _similar_pairs(signs: DataFrame, scale: float) -> DataFrame | None:
    """Links (u, v) that join all similar rows that share a bucket, or None without any bucket of two."""
    vectors = signs.select(F.col("row").alias("u"), "vector")
    buckets = signs.select(F.explode("bands").alias("key"), F.col("row").alias("u"), "size").distinct()
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = shared_table(buckets.join(sizes, "key"), "dup-members")
    if not members.limit(1).count():
        return None
    # The member of the largest buckets is the likeliest origin of the others.
    scored = members.join(members.groupBy("u").agg(F.sum("n").alias("s")), "u")
    leads = scored.groupBy("key").agg(F.max_by("u", F.struct("s", -F.col("u"))).alias("v"), F.count("*").alias("n"), F.min("u").alias("least"), F.sum(F.xxhash64("u").cast("decimal(20,0)")).alias("sum"))
    # Of buckets with the same members one is enough.
    leads = leads.groupBy("n", "least", "sum", "v").agg(F.min("key").alias("key")).select("key", "v")
    pairs = shared_table(members.select("key", "u", "size").join(leads, "key").where("u <> v"), "dup-pairs")
    drop(members)
    both = pairs.select("u", "v").distinct().join(vectors.withColumnRenamed("vector", "a"), "u").join(vectors.select(F.col("u").alias("v"), F.col("vector").alias("b")), "v")
    judged = shared_table(map_arrow(both.select("u", "v", "a", "b"), _judge(scale), "u long, v long, alike boolean"), "dup-judged")
    links = judged.where("alike").select("u", "v")
    # Members unlike their bucket's first are compared with all others of the bucket.
    rest = shared_table(pairs.join(judged, ["u", "v"]).select("key", "u", "size", "alike"), "dup-rest")
    drop(pairs)
    unlike = F.when(~F.col("alike"), F.col("size"))
    sizes = rest.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("mz"), F.count(unlike).alias("q"), F.sum(unlike).alias("qz")).where("q > 0 AND m > 1")
    sizes = sizes.select("key", _chunks("m", "mz").alias("ms"), _chunks("q", "qz").alias("qs"))
    spot = F.pmod(F.xxhash64("u"), F.lit(1 << 40))
    r = rest.join(sizes, "key")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = r.where("NOT alike").select("key", (spot % F.col("qs")).alias("qc"), span("ms").alias("mc"), F.lit(0).alias("side"), "u")
    m = r.select("key", span("qs").alias("qc"), (spot % F.col("ms")).alias("mc"), F.lit(1).alias("side"), "u")
    dealt = q.unionByName(m).join(vectors, "u").repartition("key", "qc", "mc").sortWithinPartitions("key", "qc", "mc", "side")
    more = shared_table(map_arrow(dealt, _compare(scale), "u long, v long"), "dup-links")
    drop(rest)
    return links.unionByName(more)


def _classes(blocks: Blocks) -> DataFrame:
    """Per row: row, doc_id, component_id (the class's smallest doc_id), leader (the row that stands for its class)."""
    scale = float(np.log2(blocks.n_docs + 1)) or 1.0
    answers = ask(blocks, _request, _respond, "dup-df")
    signed = shared_table(finish(blocks, answers, _signer(scale), _SIGNED_SQL), "dup-signed")
    drop(answers)
    prints = signed.select("row", "doc_id", "h1", "h2", "n_words")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # A table of its own: the join below then exchanges both sides, and a hot class can be dealt to many tasks.
    firsts = shared_table(prints.where("n_words > 0").groupBy("h1", "h2").agg(F.min(own).alias("f")).select("h1", "h2", "f", F.col("f.row").alias("first")), "dup-firsts")
    signs = shared_table(signed.where("bands IS NOT NULL").join(firsts.select(F.col("first").alias("row")), "row", "left_semi").select("row", "bands", "size", "vector"), "dup-signs")
    links = _similar_pairs(signs, scale)
    if links is not None:
        found = shared_table(components(links), "dup-components")
        grouped = firsts.join(found.withColumnRenamed("node", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))
        leaders = grouped.groupBy("component").agg(F.min("f").alias("leader"))
        firsts = grouped.join(leaders, "component").select("h1", "h2", "leader")
    else:
        firsts = firsts.select("h1", "h2", F.col("f").alias("leader"))
    same = prints.where("n_words > 0").join(firsts, ["h1", "h2"]).select("row", "doc_id", "leader")
    return same.unionByName(prints.where("n_words = 0").select("row", "doc_id", own.alias("leader"))).select("row", "doc_id", F.col("leader.doc_id").alias("component_id"), F.col("leader.row").alias("leader"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, component_id (the class's smallest doc_id), kept (the one row of its class that stays)."""
    return _classes(block_table(docs, "dup-blocks")).select("doc_id", "component_id", (F.col("row") == F.col("leader")).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which each class keeps one row: that of its smallest id, the first of repeated ones."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    blocks = block_table(docs, "dup-blocks", keep)
    kept = kept_rows(blocks, _classes(blocks).where("row = leader").select("row"), docs, keep)
    return kept
