"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

Two models, of toxic and of ordinary texts, are fitted on a sample of labelled
training rows: in the order of a hash of their ids, at most SAMPLE_DOCS of either
class, the rarer one whole if it has fewer, and SAMPLE_BYTES of text in all. Where
the texts take more, each gives one stretch of it, up to one length for all and at
a place that its id's hash chooses, so that a long text takes no other's place.

Words count by Kneser-Ney's continuation counts, the number of different words
before them, and pairs by the number of different words behind them, so that a
passage copied a thousand times counts once. Every expression (a word, or a pair
of words) has an absolutely discounted probability in each class, interpolated
with a backoff that the classes share: the pooled counts for words, and the pooled
pair with the class's word for pairs. The weight of a class's own estimate is the
posterior probability that the texts with the expression are dealt to the classes
otherwise than the rest, one expression in all being expected to differ; none has
weight zero, and rare ones have little. Each class's words, one unknown word among
them, have probabilities that sum to one. Pairs are not scaled to one for each
first word: on held-out texts that told less (README).

Scores come from the difference of the two log-likelihoods, in all and per word,
by a logistic curve. It is fitted on texts of the sample by models that have not
seen them, at the sample's share of toxic texts. Where those tell no more than
chance, as on a few dozen texts, scores rank by the difference but stay below one
half. Scoring is map-only: the model, of bounded size because its sample is, is
broadcast; very long texts are scored whole, in a step of their own.

Defined cases: null, empty and wordless texts have no evidence and score as a
text of one word that says nothing; labels other than 0 and 1, or of unknown
documents, are left out; repeated label rows count by their largest label; of the
documents of one id one is learned from, that of the least hash; without training
rows of both classes every score is NO_MODEL_SCORE.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import batch, documents, drop, id_crc, map_arrow, shared_table

FOLDS, HELD_OUT = 5, 0
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 12 << 20
DISCOUNT = 0.75
#: How evenly texts deal an expression that does not differ: as many earlier texts at the common rate.
EVENNESS = 30.0
#: Parts of the sample; the curve sees each by a model of the others.
PARTS = 10
#: Least gain in deviance on unseen texts by which the curve tells more than chance (chi-squared, two degrees of freedom, 1 %).
TELLING = 9.21
NO_MODEL_SCORE = 0.0
_PAIR = np.uint64(0xA24BAED4963EE407)
_AT_ONCE = 1 << 16


def _before(words: B.Words, h: np.ndarray) -> np.ndarray:
    """The word before each word; a text's first word has none before it."""
    before = np.concatenate([[np.uint64(1)], h[:-1]]) if len(h) else h.copy()
    before[words.doc[:-1][words.counts() > 0]] = np.uint64(1)
    return before


def _pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A key for each word with the word before it."""
    return B.mix(before * _PAIR + (before >> np.uint64(31)) + h)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, to which smaller arguments are raised."""
    below = np.ones_like(x)
    for k in range(8):
        below = below * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) - np.log(below)


def _own_weight(a: np.ndarray, b: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The posterior probability that a toxic and b ordinary texts come of a rate of their own, not of the given rate of toxic ones."""
    out = np.empty(len(a))
    # A part at a time, so that the terms of all expressions are never held at once.
    for k in range(0, len(a), _AT_ONCE):
        own = slice(k, k + _AT_ONCE)
        alike = _log_beta(a[own] + EVENNESS * rate[own], b[own] + EVENNESS * (1 - rate[own])) - _log_beta(EVENNESS * rate[own], EVENNESS * (1 - rate[own]))
        odds = _log_beta(a[own] + 1.0, b[own] + 1.0) - alike - np.log(max(len(a), 2) - 1)
        # Even a sure expression leaves the shared backoff its part.
        out[own] = 1 / (1 + np.exp(-np.clip(odds, None, 36)))
    return out


@dataclass
class Model:
    """Log-ratios (toxic over ordinary) of words and of an unknown one, those of words after a given word, and the curve."""

    keys: np.ndarray
    ratios: np.ndarray
    pair_keys: np.ndarray
    pair_ratios: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: log-likelihood toxic less ordinary over its expressions, and its words."""
        words = B.scan(column)
        n = words.counts()
        h = words.hashes()
        r = _looked_up(self.keys, self.ratios[:-1], h, self.ratios[-1])
        if len(self.pair_keys):
            r = _looked_up(self.pair_keys, self.pair_ratios, _pairs(_before(words, h), h), r)
        # Against what a word says that neither class knows.
        r = r - self.ratios[-1]
        return np.bincount(words.owner(), r, len(n)) if len(h) else np.zeros(len(n)), n

    def features(self, evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
        per_word = evidence / np.maximum(n, 1)
        return np.stack([np.ones(len(n)), np.arcsinh(1000 * per_word), np.clip(evidence, -20, 20) / 4], axis=1)

    def score(self, evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not self.curve[1:].any():
            return 0.5 / (1 + np.exp(-np.clip(evidence, -20, 20)))
        return 1 / (1 + np.exp(-self.features(evidence, n) @ self.curve))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(otherwise, len(wanted)).astype(float)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def fit(texts: Iterable[tuple[str, int]]) -> Model | None:
    """Fits both models and the curve on labelled texts."""
    rows = list(texts)
    y = np.array([t for _, t in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    column = pa.array([t for t, _ in rows], pa.string())
    del rows
    sample = _Sample(column, y)
    part = np.zeros(len(y), np.int64)
    for t in (0, 1):
        part[y == t] = np.arange((y == t).sum()) % PARTS
    evidence = np.zeros(len(y))
    for k in range(PARTS):
        if (part == k).any():
            evidence[part == k] = sample.evidence(*sample.ratios(part != k))[part == k]
    ratio, pair_ratio = sample.ratios(np.ones(len(y), bool))
    model = Model(sample.kinds, ratio, sample.pairs, pair_ratio.astype(np.float32))
    x = model.features(evidence, sample.n)
    used = [0, 1, 2]
    while True:
        model.curve = np.zeros(3)
        model.curve[used] = _logistic(x[:, used], y)
        # More toxic evidence never lowers a score.
        if (wrong := [k for k in used[1:] if model.curve[k] < 0]) == []:
            p = np.where(y == 1, 1, -1) * (x @ model.curve)
            if 2 * (len(y) * np.log(2) - np.logaddexp(0, -p).sum()) < TELLING:
                model.curve = np.zeros(3)
            return model
        used.remove(min(wrong, key=lambda k: model.curve[k]))


def _numbered(keys: np.ndarray, firsts: bool = False) -> tuple[np.ndarray, ...]:
    """The distinct keys, where each stands first if that is asked, and the number of each key's own."""
    *found, of = np.unique(keys, return_index=firsts, return_inverse=True)
    return (*found, of.astype(np.int32))


class _Sample:
    """The words and pairs of labelled texts, counted once; models of any of the texts are made from that."""

    def __init__(self, texts: pa.Array, y: np.ndarray) -> None:
        # The driver does this: what is no longer needed goes before the next array of all words is made.
        words = B.scan(texts)
        self.y, self.n, self.owner = y, words.counts(), words.owner().astype(np.int32)
        h = words.hashes()
        before = _before(words, h)
        del words
        pair = _pairs(before, h)
        self.kinds, self.which = _numbered(h)
        del h
        self.pairs, first, self.at = _numbered(pair, True)
        del pair
        #: Of each pair its word, and the number of the word before.
        self.word = self.which[first]
        self.context = _numbered(before[first])[1]
        del before
        # A pair and the word behind it.
        triple = self.at.astype(np.int64) * (len(self.kinds) + 1)
        triple += np.append(self.which[1:], len(self.kinds)) if len(self.which) else self.which
        _, first, self.triple = _numbered(triple, True)
        self.pair_of = self.at[first]
        #: Each word's and each pair's texts, once.
        self.word_texts, self.pair_texts = (self._once(k, size) for k, size in ((self.which, len(self.kinds)), (self.at, len(self.pairs))))

    def _once(self, key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(self.owner.astype(np.int64) * max(size, 1) + key)
        return (both % max(size, 1)).astype(np.int32), (both // max(size, 1)).astype(np.int32)

    def _texts(self, once: tuple[np.ndarray, np.ndarray], size: int, of: np.ndarray) -> np.ndarray:
        return np.bincount(once[0][of[once[1]]], minlength=size).astype(float)

    def probabilities(self, seen: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """From the seen texts, of the toxic and the ordinary class: each word's probability, an unknown one's last, and each pair's after its first word."""
        classes = [seen & (self.y == 1), seen & (self.y == 0)]
        rate = np.clip(classes[0].sum() / max(seen.sum(), 1), 1e-6, 1 - 1e-6)
        # One more word stands for all that the sample has not.
        nw, np_ = len(self.kinds) + 1, len(self.pairs)
        counts, behind = [], []
        for of in classes:
            own = of[self.owner]
            counts.append(np.bincount(self.word[np.bincount(self.at[own], minlength=np_) > 0], minlength=nw).astype(float))
            behind.append(np.bincount(self.pair_of[np.bincount(self.triple[own], minlength=len(self.pair_of)) > 0], minlength=np_).astype(float))
        # A word of texts that are left out is as one of which each class has a part of one count.
        pooled = np.maximum(counts[0] + counts[1], DISCOUNT)
        shared = pooled / max(pooled.sum(), 1)
        weight = _own_weight(*(self._texts(self.word_texts, nw, of) for of in classes), np.full(nw, rate))
        p = []
        for c in counts:
            n = max(c.sum(), 1)
            word = weight * (np.maximum(c - DISCOUNT, 0) + DISCOUNT * np.minimum(c, 1).sum() * shared) / n + (1 - weight) * shared
            p.append(word / max(word.sum(), 1e-300))

        # A pair that differs no more than its word has its texts in the word's proportion.
        odds = rate / (1 - rate) * (p[0] / p[1])[self.word]
        weight = _own_weight(*(self._texts(self.pair_texts, np_, of) for of in classes), np.clip(odds / (1 + odds), 1e-6, 1 - 1e-6))
        shared_after = self._contexts(behind[0] + behind[1])
        q = []
        for c, w in zip(behind, p, strict=True):
            own_after, of_class = self._contexts(c), np.empty(np_)
            for k in range(0, np_, _AT_ONCE):
                at = slice(k, k + _AT_ONCE)
                lower = w[self.word[at]]
                own, left = self._after(c[at], own_after, at)
                both, backoff = self._after(behind[0][at] + behind[1][at], shared_after, at)
                # The pooled pair, of the class's word.
                common = (both / shared[self.word[at]] + backoff) * lower
                of_class[at] = weight[at] * (own + left * lower) + (1 - weight[at]) * common
            q.append(of_class)
        return p, q

    def ratios(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-ratio of each word and of each pair, from the seen texts; a pair or word that they lack has its backoff's."""
        p, q = self.probabilities(seen)
        return tuple(np.log(x[0]) - np.log(x[1]) for x in (p, q))

    def _contexts(self, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each first word the counts of its pairs, and the weight that their discounts leave to the word behind it."""
        size = int(self.context.max(initial=-1)) + 1
        total = np.bincount(self.context, behind, size)
        kinds = np.bincount(self.context, np.minimum(behind, 1), size)
        n = np.maximum(total, 1)
        return n, np.where(total > 0, DISCOUNT * kinds / n, 1.0)

    def _after(self, behind: np.ndarray, contexts: tuple[np.ndarray, np.ndarray], at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Of each of the pairs at a place the discounted probability after its first word, and the weight that this leaves to the word."""
        n, free = (x[self.context[at]] for x in contexts)
        return np.maximum(behind - DISCOUNT, 0) / n, free

    def evidence(self, ratio: np.ndarray, pair_ratio: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, (pair_ratio - ratio[-1])[self.at], len(self.n)) if len(self.at) else np.zeros(len(self.n))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method for a logistic curve with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Iterator[tuple[str, int]]:
    """Labelled texts outside the held-out fold, at most `most` of a class, in an order that their ids' hash gives."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").where(fold != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = [(r["doc_id"], t) for t in (1, 0) for r in known.where(F.col("toxic") == t).orderBy(*order).limit(most).select("doc_id").collect()]
    spark = docs.sparkSession
    # At most 2 * most ids: a bounded table to broadcast.
    ids = spark.createDataFrame(rows, "doc_id long, toxic int")
    sample = documents(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = shared_table(sample, "toxic-sample")
    share = _share([r["n"] or 0 for r in sample.select(F.octet_length("text").alias("n")).collect()], SAMPLE_BYTES)
    spare = F.greatest(F.length("text") - share, F.lit(0))
    begin = F.when(spare > 0, F.pmod(F.xxhash64("doc_id"), spare + 1)).otherwise(0).cast("int")
    stretch = sample.select("doc_id", F.substring(F.col("text"), begin + 1, F.lit(share)).alias("text"), "toxic").orderBy(*order)
    for r in stretch.toLocalIterator():
        yield _head(r["text"] or "", share), r["toxic"]
    drop(sample)


def _share(lengths: list[int], most: int) -> int:
    """The largest number of bytes that each text may give so that all give `most` together."""
    left = most
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return most


def _head(text: str, most: int) -> str:
    """The whole words that begin a text in at most `most` bytes; a first word that is longer is cut."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    head = raw[:most].decode(errors="ignore")
    return head.rsplit(None, 1)[0] if len(head.split()) > 1 else head


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.float64()), ("n_words", pa.int64())])
_SQL = "doc_id long, held_out boolean, score double, predicted int, evidence double, n_words long"


def _scorer(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in B.chunks(batches):
            if model is None:
                score, evidence, n = np.full(piece.num_rows, NO_MODEL_SCORE), np.zeros(piece.num_rows), np.zeros(piece.num_rows)
            else:
                evidence, n = model.evidence(piece.column("text"))
                score = model.score(evidence, n)
            yield batch(_SCHEMA, piece.column("doc_id"), id_crc(piece.column("doc_id")) % FOLDS == HELD_OUT, score, (score >= 0.5).astype(np.int32), evidence, np.asarray(n, np.int64))

    return scored


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(training_sample(docs, labels))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1), predicted, evidence (log-likelihood difference), n_words."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return map_arrow(documents(docs), _scorer(model), _SQL)


def _keeper(shared):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in B.chunks(batches):
            if model is None:
                yield piece
            else:
                yield piece.filter(pa.array(model.score(*model.evidence(piece.column("text"))) < 0.5))

    return kept


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return map_arrow(docs, _keeper(model), docs.schema)
