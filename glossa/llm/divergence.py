"""Source divergence audit: how far the sources of a language use its terms differently.

A language keeps the terms that enough of its documents have. Each source of it, and the
language as a whole, gives each kept term a smoothed frequency in whole billionths, and the
squared difference of two frequencies over their sum, rounded down, says how far two sources
differ in a term. Its sum over all kept terms is the distance of two sources; the terms in
which a source stands out most from its language are listed for it. All arithmetic is
between whole numbers.

How it runs: a task sorts the words of a piece of its texts by (language, term, source,
document) and scans the runs, which gives partial document frequencies and counts. Partials
are dealt out by (language, term) and sorted by (language, term, source); a second scan of
runs sums them, drops the terms that too few documents have, and writes one row for each
kept term with its sources and counts. A term of any frequency is one partial for each
source and piece of text, and a scan holds one term's sources. With the totals of each
source known, a third scan goes along the kept terms and emits, for each task, partial sums
of pairs of sources and the best terms of each source; sums and ranks of these make the
result. Only a pair's terms that either source has are worked out one by one: what neither
has contributes the same amount each time.

Totals of sources (one row for each source of a language) go to every task. They are no
more than the square root of the result, which has a row for each ordered pair of them.

Defined cases: a null text, language or source is an empty one; an empty source is a source;
a source whose documents have no kept terms is audited like any other, with counts of 0; a
language with no kept terms has distances of 0 and no terms; a text of any length is worked
on whole; repeated rows are documents of their own; ties are ranked by the bytes of the
name; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as B
from .common import PARTITIONS, batch, map_arrow, shared_table

#: Documents of a language in which a kept term occurs, at least.
LEAST_DOCS = 10
#: Terms that are listed for a source.
TOP = 10
SCALE = 1_000_000_000
#: Frequencies that the third scan works on at once.
_CELLS = 1 << 20
#: Partials of pairs of sources that a task holds, before it emits them.
_HELD = 1 << 20

#: Word bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and whatever is not ASCII.
_LETTERS = B.ALNUM.copy()
_LETTERS[ord("0") : ord("9") + 1] = False

_PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _terms(words: B.Words) -> tuple[np.ndarray, list[str]]:
    """A number for each word, and the distinct words by number."""
    ends = np.append(words.start, len(words.data)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(words.data)])
    d = column.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), [x[:-1].decode() for x in d.dictionary.to_pylist()]


def _partials(docs: pa.RecordBatch) -> pa.RecordBatch:
    """Partial counts of a piece's texts; the term '' marks every source that occurs."""
    words = B.scan(docs.column("text"), _LETTERS)
    code, names = _terms(words)
    langs, of_lang = np.unique(np.array(docs.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    sources, of_source = np.unique(np.array(docs.column("source").to_pylist(), object).astype(str), return_inverse=True)
    owner = words.owner()
    order = np.lexsort((owner, of_source[owner], code, of_lang[owner]))
    code, owner = code[order], owner[order]
    lang, source = of_lang[owner], of_source[owner]
    each = _runs(lang, code, source, owner)
    runs = _runs(lang, code, source)
    n = np.diff(np.append(runs, len(code)))
    n_docs = np.diff(np.append(np.searchsorted(each, runs), len(each)))
    marks = sorted(set(zip(of_lang.tolist(), of_source.tolist(), strict=True)))
    return batch(
        _PARTIAL,
        [langs[a] for a, _ in marks] + langs[lang[runs]].tolist(),
        [""] * len(marks) + [names[k] for k in code[runs].tolist()],
        [sources[b] for _, b in marks] + sources[source[runs]].tolist(),
        np.concatenate([np.zeros(len(marks), np.int64), n_docs]),
        np.concatenate([np.zeros(len(marks), np.int64), n]),
    )


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Kept terms of partials that are sorted by (lang, term, source)."""
    at, df, sources, counts, out = None, 0, [], [], []

    def closed() -> None:
        if at is not None and (df >= least or at[1] == ""):
            out.append((*at, sources, counts))

    def rows() -> pa.RecordBatch:
        return batch(_KEPT, *([r[k] for r in out] for k in range(4)))

    for b in batches:
        lang, term, source = (b.column(c).dictionary_encode() for c in ("lang", "term", "source"))
        code = [x.indices.to_numpy() for x in (lang, term, source)]
        names = [x.dictionary.to_pylist() for x in (lang, term, source)]
        runs = _runs(*code) if b.num_rows else np.zeros(0, np.int64)
        docs, n = (np.add.reduceat(b.column(c).to_numpy(), runs) if len(runs) else [] for c in ("docs", "n"))
        for i, d, k in zip(runs.tolist(), list(docs), list(n), strict=True):
            key = names[0][code[0][i]], names[1][code[1][i]]
            if key != at:
                closed()
                at, df, sources, counts = key, 0, [], []
            df += int(d)
            own = names[2][code[2][i]]
            if sources and sources[-1] == own:
                counts[-1] += int(k)
            else:
                sources.append(own)
                counts.append(int(k))
        if len(out) >= 10_000:
            yield rows()
            out = []
    closed()
    yield rows()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Each language's kept terms with the sources that have them and how often, in the shared folder; the term '' has all sources of the language."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.chunks(batches):
            yield _partials(piece)

    # Two for each partition of the input, whose size Spark's reader bounds, so what one of them gets does not grow.
    n = max(docs.sparkSession.sparkContext.defaultParallelism, min(PARTITIONS, 2 * rows._jdf.queryExecution().toRdd().getNumPartitions()))
    found = map_arrow(rows, partials, "lang string, term string, source string, docs long, n long")
    order = ["lang", "term", "source"]
    dealt = found.repartition(n, "lang", "term").sortWithinPartitions(*order)
    return shared_table(map_arrow(dealt, lambda it: _merged(it, least), "lang string, term string, sources array<string>, counts array<long>"), "audit-terms")


def _frequency(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total): long division by thousands, so that no product leaves 64 bits."""
    q, r = np.divmod(count + 2, total)
    for _ in range(3):
        step, r = np.divmod(r * 1000, total)
        q = q * 1000 + step
    return q + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class _Language:
    """What a task gathers for one language. sources: all of them, sorted; words: each one's occurrences of kept terms; v: kept terms."""

    def __init__(self, sources: list[str], words: list[int], v: int) -> None:
        self.sources, self.at = sources, {s: k for k, s in enumerate(sources)}
        self.total = np.array(words, np.int64) + 2 * v
        self.all = sum(words) + 2 * v
        self.rest = _frequency(np.zeros(len(sources), np.int64), self.total)
        self.sums: dict[int, np.ndarray] = {}
        self.best: dict[int, list[tuple[int, str]]] = defaultdict(list)
        self.terms: list[str] = []
        self.cells: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.terms.append(term)
        self.cells.append((np.array([self.at[s] for s in sources], np.int64), np.array(counts, np.int64)))
        if len(self.terms) * len(self.sources) >= _CELLS:
            self.flush()

    def flush(self) -> None:
        """Works out the terms gathered so far."""
        if not self.terms:
            return
        n = len(self.sources)
        row = np.repeat(np.arange(len(self.terms)), [len(c) for c, _ in self.cells])
        col, count = (np.concatenate(x) for x in zip(*self.cells, strict=True))
        p = np.tile(self.rest, (len(self.terms), 1))
        p[row, col] = _frequency(count, self.total[col])
        has = np.zeros(p.shape, bool)
        has[row, col] = True
        everywhere = _frequency(np.bincount(row, count, len(self.terms)).astype(np.int64) if len(row) < 2**31 and count.sum() < 2**53 else np.add.reduceat(count, np.flatnonzero(np.diff(row, prepend=-1))), np.int64(self.all))
        for i in np.unique(col).tolist():
            own = np.flatnonzero(has[:, i])
            # Against each later source in all of this source's terms, and against each earlier one in those that it lacks.
            f = _apart(p[own, i, None], p[own])
            f[:, :i][has[own, :i]] = 0
            f[:, i] = 0
            count_of = np.full(n, len(own), np.int64)
            count_of[:i] -= has[own, :i].sum(axis=0)
            got = self.sums.setdefault(i, np.zeros((2, n), np.int64))
            got += np.stack([f.sum(axis=0), count_of])
            value, above = _apart(p[own, i], everywhere[own]), p[own, i] > everywhere[own]
            some = own[above]
            self.best[i] = sorted([*self.best[i], *zip((-value[above]).tolist(), (self.terms[k] for k in some.tolist()), strict=True)])[:TOP]
        self.terms, self.cells = [], []


def _found(batches: Iterator[pa.RecordBatch], figures: dict[str, tuple[list[str], list[int], int]]) -> Iterator[pa.RecordBatch]:
    """Partial pairs (part pair: how much the terms add that either source has, part rest: minus how many those are) and each source's best terms."""
    gathered: dict[str, _Language] = {}

    def emitted(lang: str, own: _Language) -> Iterator[tuple]:
        own.flush()
        names = own.sources
        for i, (value, n) in own.sums.items():
            for j in np.flatnonzero(n).tolist():
                if i != j:
                    a, b = (i, j) if i < j else (j, i)
                    yield lang, names[a], "pair", names[b], int(value[j])
                    yield lang, names[a], "rest", names[b], -int(n[j])
        for i, best in own.best.items():
            for value, term in best:
                yield lang, names[i], "term", term, -value
        own.sums, own.best = {}, defaultdict(list)

    def rows(lang: str) -> Iterator[pa.RecordBatch]:
        out = []
        for r in emitted(lang, gathered[lang]):
            out.append(r)
            if len(out) >= 50_000:
                yield batch(_FOUND, *map(list, zip(*out, strict=True)))
                out = []
        if out:
            yield batch(_FOUND, *map(list, zip(*out, strict=True)))

    for b in batches:
        for r in b.to_pylist():
            lang = r["lang"]
            if lang not in gathered:
                gathered[lang] = _Language(*figures[lang])
            gathered[lang].add(r["term"], r["sources"], r["counts"])
            if len(gathered[lang].sums) * len(gathered[lang].sources) > _HELD:
                yield from rows(lang)
    for lang in gathered:
        yield from rows(lang)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): each source's distance to each other of its language, and the terms in which it stands out."""
    spark = docs.sparkSession
    kept = kept_terms(docs, least)
    pairs = F.explode(F.arrays_zip("sources", "counts")).alias("x")
    groups = shared_table(kept.select("lang", pairs).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("words")), "audit-groups")
    vocabulary = {r["lang"]: r["v"] for r in kept.where("term <> ''").groupBy("lang").agg(F.count("*").alias("v")).collect()}
    figures: dict[str, tuple[list[str], list[int], int]] = {}
    for r in sorted(groups.collect()):
        own = figures.setdefault(r["lang"], ([], [], vocabulary.get(r["lang"], 0)))
        own[0].append(r["source"])
        own[1].append(r["words"])
    told = spark.sparkContext.broadcast(figures)
    found = shared_table(map_arrow(kept.where("term <> ''"), lambda it: _found(it, told.value), "lang string, source string, part string, item string, value long"), "audit-found")
    # What two sources add in a term that neither has.
    sums = found.where("part <> 'term'").groupBy("lang", "source", "item").agg(F.sum(F.expr("if(part = 'pair', value, 0)")).alias("value"), F.sum(F.expr("if(part = 'rest', value, 0)")).alias("less"))
    total = F.col("words") + 2 * F.col("v")
    rest = F.when(F.col("v") == 0, 0).otherwise(1 + F.expr(f"{2 * SCALE}L div greatest(words + 2 * v, 1)")).cast("long")
    v = spark.createDataFrame([*vocabulary.items()], "lang string, v long")
    sides = groups.join(F.broadcast(v), "lang", "left").fillna(0, ["v"]).select("lang", "source", "v", rest.alias("rest"))
    a, b = sides.alias("a"), sides.alias("b")
    # The pairs are the result itself: each source of a language with each other one.
    every = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select("a.lang", "a.source", F.col("b.source").alias("item"), "a.v", F.col("a.rest").alias("p"), F.col("b.rest").alias("q"))
    none = F.expr("if(v = 0, 0L, ((p - q) * (p - q)) div greatest(p + q, 1L))")
    known = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + none * (F.col("v") + F.coalesce("less", F.lit(0)))).alias("value"))
    both = known.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return both.withColumn("rank", rank).unionByName(terms)
