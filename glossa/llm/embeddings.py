"""Embedding near-dedup: an inverted multi-index with multi-sequence traversal.

Unit vectors are cut into two halves, each with a codebook of its own; the
product of the codebooks is a grid of cells. A vector's traversal visits cells in
order of distance, by a heap over the two sorted lists of centroids, and stops
at the distance within which, on a sample, TARGET of neighbours at exactly the
threshold lie. What is visited is verified by exact cosine in double precision.

Vectors of each length have an index of their own: only vectors of equal length
have a cosine. Codebooks and stopping distances are fitted on a sample of at most
SAMPLE vectors, or SAMPLE_A_CENTROID for each centroid where many vectors ask for
larger codebooks; every vector is indexed and compared. A length that the sample
hardly holds has one cell, in which all are compared. Equal vectors are one entry
with a multiplicity. A cell's entries are cut into chunks of at most CHUNK, and
probes meet members a chunk pair at a time, in a matrix product; a hot cell is
many bounded tasks, and a chunk pair sends on counts and a spanning forest of its
links, never its pairs.

Codebooks grow with the root of the number of vectors up to LARGEST centroids a
half, which keeps about 16 vectors a cell up to 16 * LARGEST ** 2 of them (a
thousand million); beyond that cells grow, results stay whole.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (n_links 0, a class of their own); rows that share
a vec_id are vectors of their own, linked by what they hold, not by their id; a
null vec_id has a null class unless a vector that it links with has an id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop, map_arrow, shared_table
from .graph import components, forest

THRESHOLD = 0.9
SAMPLE = 8192
LARGEST = 8192
SAMPLE_A_CENTROID = 8
TARGET = 0.97
CHUNK = 2048
ROUNDS = 8


def unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Usable rows of a list column and their vectors in double precision, scaled to length one."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows, out = [], []
    for width in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == width)
        x = pc.list_flatten(lists.take(pa.array(own))).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), width)
        scale = np.abs(x).max(axis=1)
        good = np.isfinite(scale) & (scale > 0) & np.isfinite(x).all(axis=1)
        # Scaled by the largest component first: squares of very large or small numbers would leave the range.
        x = x[good] / scale[good, None]
        rows.extend(own[good].tolist())
        out.extend(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    return np.array(rows, np.int64), out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norms = (centroids**2).sum(axis=1)
    parts = [(2 * x[i : i + CHUNK] @ centroids.T - norms).argmax(axis=1) for i in range(0, len(x), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def codebook(x: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:size]]
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class MultiIndex:
    """Two codebooks and the distance at which a traversal may stop."""

    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float) -> None:
        self.first, self.second, self.reach = first, second, reach

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.first) * len(self.second) + _nearest(x[:, self.half :], self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to the centroids."""
        return tuple(np.maximum((h * h).sum(axis=1)[:, None] - 2 * h @ c.T + (c * c).sum(axis=1), 0) for h, c in ((x[:, : self.half], self.first), (x[:, self.half :], self.second)))

    def traverse(self, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[float, int]]:
        """Cells of one vector by growing distance: (squared distance, cell)."""
        a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
        u, v = near[a].tolist(), far[b].tolist()
        a, b = a.tolist(), b.tolist()
        heap, width = [(u[0] + v[0], 0, 0)], len(b)
        while heap:
            d, i, j = heapq.heappop(heap)
            yield d, a[i] * width + b[j]
            if j + 1 < len(v):
                heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (u[i + 1] + v[0], i + 1, 0))

    def excess(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How much farther than the nearest cell of x the cell of y is, row by row."""
        near, far = self.distances(x)
        a, b = np.divmod(self.cells(y), len(self.second))
        rows = np.arange(len(x))
        return near[rows, a] + far[rows, b] - near.min(axis=1) - far.min(axis=1)

    def probes(self, x: np.ndarray) -> list[list[int]]:
        """For each vector the cells that its traversal visits: all within reach of the nearest one."""
        out = []
        for near, far in zip(*self.distances(x), strict=True):
            own = []
            for d, cell in self.traverse(near, far):
                if own and d > least + self.reach:
                    break
                if not own:
                    least = d
                own.append(cell)
            out.append(own)
        return out


def book_size(n: int) -> int:
    """Centroids of a half for n vectors."""
    return int(min(max(4, round((n / 16) ** 0.5)), LARGEST))


def fit(x: np.ndarray, n: int) -> MultiIndex:
    """Codebooks for n vectors of one length, and the reach, from a sample of them; one cell where the sample is too small."""
    half = max(1, x.shape[1] // 2)
    if len(x) < SAMPLE_A_CENTROID:
        return MultiIndex(x[:1, :half], x[:1, half:], 0.0)
    size = min(book_size(n), max(1, len(x) // 4))
    index = MultiIndex(codebook(x[:, :half], size), codebook(x[:, half:], size), 0.0)
    # Neighbours at exactly the threshold, in random directions: no link is harder to find.
    aside = np.random.default_rng(11).normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
    other = THRESHOLD * x + (1 - THRESHOLD**2) ** 0.5 * aside
    excess = [np.minimum(index.excess(a, b), index.excess(b, a)) for a, b in ((x[i : i + CHUNK], other[i : i + CHUNK]) for i in range(0, len(x), CHUNK))]
    index.reach = float(np.quantile(np.concatenate(excess), TARGET))
    return index


_ENTRY = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("vector", pa.binary())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, vectors = unit(b.column("embedding"))
        out, widths = [None] * b.num_rows, [None] * b.num_rows
        for r, v in zip(rows.tolist(), vectors, strict=True):
            out[r], widths[r] = v.astype("<f8").tobytes(), len(v)
        yield batch(_ENTRY, b.column("vec_id"), widths, out)


def _stacked(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


_PROBE = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("vector", pa.binary()), ("home", pa.int64()), ("visits", pa.list_(pa.int64()))])


def _probes(shared):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                widths, vectors = b.column("width").to_numpy(), b.column("vector")
                homes, visits = np.zeros(b.num_rows, np.int64), [[0]] * b.num_rows
                for w in np.unique(widths).tolist():
                    rows = np.flatnonzero(widths == w)
                    if (index := indexes.get(w)) is None:
                        continue
                    x = _stacked(vectors.take(pa.array(rows)).to_pylist())
                    homes[rows] = own = index.cells(x)
                    for r, h, v in zip(rows.tolist(), own.tolist(), index.probes(x), strict=True):
                        visits[r] = [h, *(c for c in v if c != h)]
                yield batch(_PROBE, b.column("node"), b.column("n"), b.column("width"), vectors, homes, visits)

    return made


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


class _Group:
    """Probes and members of one chunk pair of a cell."""

    def __init__(self, cell: int) -> None:
        self.cell = cell
        self.rows: tuple[list, list] = ([], [])

    def found(self) -> Iterator[pa.RecordBatch]:
        probes, members = self.rows
        if not probes or not members:
            return
        m_id, m_n = (np.array([r[k] for r in members], np.int64) for k in (0, 1))
        y = _stacked([r[2] for r in members])
        homes = np.unique([r[3] for r in probes])
        place = {h: k for k, h in enumerate(homes.tolist())}
        visited = np.zeros((len(members), len(homes)), bool)
        for k, r in enumerate(members):
            for c in r[4]:
                if c in place:
                    visited[k, place[c]] = True
        counts: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        for i in range(0, len(probes), 512):
            part = probes[i : i + 512]
            q_id, q_n, home = (np.array([r[k] for r in part], np.int64) for k in (0, 1, 3))
            linked = _stacked([r[2] for r in part]) @ y.T >= THRESHOLD
            if not linked.any():
                continue
            here = home == self.cell
            # A pair is counted once: within a cell from its smaller id; between cells that visit each other, in the smaller cell.
            linked &= np.where(here[:, None], q_id[:, None] < m_id, ~visited[:, np.searchsorted(homes, home)].T | (self.cell < home)[:, None])
            for ids, gained in ((q_id, linked @ m_n), (m_id, q_n @ linked)):
                for k in np.flatnonzero(gained).tolist():
                    counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(gained[k])
            q_label, m_label = forest(linked)
            ids = np.concatenate([q_id, m_id])
            label = np.concatenate([q_label, m_label])
            for k in np.flatnonzero(label != np.arange(len(label))).tolist():
                edges.add((int(ids[k]), int(ids[label[k]])))
        if counts:
            pairs = sorted(edges)
            yield batch(_FOUND, [*counts, *(u for u, _ in pairs)], [*([None] * len(counts)), *(v for _, v in pairs)], [*counts.values(), *([None] * len(pairs))])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, group = None, None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("width", "cell", "qc", "mc", "side", "node", "n", "vector", "home", "visits")]
        for width, cell, qc, mc, side, *row in zip(*columns, strict=True):
            if (width, cell, qc, mc) != at:
                if group:
                    yield from group.found()
                at, group = (width, cell, qc, mc), _Group(cell)
            group.rows[side].append(row)
    if group:
        yield from group.found()


def _fitted(distinct: DataFrame) -> dict[int, MultiIndex]:
    """An index for each length of vectors that the sample holds."""
    counts = distinct.groupBy("width").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("n")).first()["n"] or 0
    size = max(SAMPLE, SAMPLE_A_CENTROID * book_size(most)) if most else 0
    # In the order of a hash of the vectors: a bounded sample that depends on nothing but the table.
    own: dict[int, list[bytes]] = {}
    for r in distinct.orderBy(F.xxhash64("key"), "key").limit(size).select("width", "vector").toLocalIterator():
        own.setdefault(r["width"], []).append(bytes(r["vector"]))
    # As many lengths as the bounded sample has, at most.
    n = {r["width"]: r["n"] for r in counts.where(F.col("width").isin(list(own))).collect()} if own else {}
    return {w: fit(_stacked(v), n[w]) for w, v in own.items()}


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Per vector row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    entries = shared_table(map_arrow(rows, _entries, "id long, width int, vector binary").withColumn("key", F.md5("vector")), "vec-entries")
    usable = entries.where("vector IS NOT NULL")
    distinct = usable.groupBy("width", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("vector").alias("vector"))
    distinct = shared_table(distinct.withColumn("node", F.monotonically_increasing_id()), "vec-distinct")
    unusable = entries.where("vector IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    indexes = _fitted(distinct)
    if not indexes:
        return unusable
    dealt = distinct.select("node", "n", "width", "vector").repartition("node")
    probes = shared_table(map_arrow(dealt, _probes(spark.sparkContext.broadcast(indexes)), "node long, n long, width int, vector binary, home long, visits array<long>"), "vec-probes")
    members = probes.groupBy("width", F.col("home").alias("cell")).agg(F.count("*").alias("m"))
    visitors = probes.select("width", F.explode("visits").alias("cell")).groupBy("width", "cell").agg(F.count("*").alias("q"))
    chunks = members.join(visitors, ["width", "cell"]).where("q > 1").select("width", "cell", F.ceil(F.col("m") / CHUNK).alias("ms"), F.ceil(F.col("q") / CHUNK).alias("qs"))
    chunks = shared_table(chunks, "vec-chunks")
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    row, cell = ["node", "n", "vector", "home", "visits"], ["width", "cell"]
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = probes.select("*", F.explode("visits").alias("cell")).join(chunks, cell).select(*cell, (spot % F.col("qs")).alias("qc"), span("ms").alias("mc"), F.lit(0).alias("side"), *row)
    m = probes.withColumn("cell", F.col("home")).join(chunks, cell).select(*cell, span("qs").alias("qc"), (spot % F.col("ms")).alias("mc"), F.lit(1).alias("side"), *row)
    group = [*cell, "qc", "mc"]
    pairs = q.unionByName(m).repartition(*group).sortWithinPartitions(*group, "side")
    found = shared_table(map_arrow(pairs, _compare, "u long, v long, links long"), "vec-found")
    drop(probes, chunks)
    links = found.where("links IS NOT NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.where("v IS NOT NULL").select("u", "v"))
    # A class is named by its smallest vec_id, which min() finds whatever ids are null.
    names = joined.join(distinct.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("name"))
    classes = joined.join(names, "component").select("node", "name")
    told = shared_table(links.join(classes, "node", "full"), "vec-told")
    own = usable.select("id", "width", "key").join(distinct.select("width", "key", "rep", "n", "node"), ["width", "key"]).join(told, "node", "left")
    component = F.coalesce("name", "rep")
    done = own.select(F.col("id").alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    return done.unionByName(unusable)
