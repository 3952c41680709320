"""LM scoring: a weighted backoff automaton of smoothed n-grams.

States are the empty context, the text's begin and each known word; an arc
leads from a context over a word that followed it in training, a failure arc
from a context to the empty one. A text is read once from left to right; the
state is carried, and the arcs' log10 probabilities are added up.

Counts come from all training documents, through exchange: each block of
documents gets the counts of its own words and word pairs, so a model of any
size is spread over the shards and a block holds only the part that it walks.

Smoothing. Words: absolute discounting, D = n1 / (n1 + 2 n2), whose mass goes to
one unknown word. Pairs: P(w | v) = (c(v, w) + M(v) P(w)) / (c(v) + M(v)) with
M(v) = SPREAD c(v) ** GROWTH, the number of different words that Heaps' law
expects behind v; it sums to one for any M. The failure arc of v weighs
M(v) / (c(v) + M(v)).

Defined cases: a very long text is a block of its own and scored whole; repeated
rows are each scored; a null text is empty and has its end token only; a null id is
empty text to crc32; without training documents every token is unknown and
scores 0. Keys are 64-bit hashes: with n different words or pairs about
n * n / 2**65 pairs of them share a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytescan as B
from .common import batch, frames, id_crc, pack, pack_sorted, unframe, unpack, unpack_sorted
from .exchange import ask, block_table, finish, from_planes, planes, shard_parts, summed, totals

SPREAD, GROWTH = 2.0, 0.9
FOLDS, HELD_OUT = 7, 2
_END, _BEGIN = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0xBE61BE61BE61BE61)
_PAIR = np.uint64(0xA24BAED4963EE407)

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Tokens:
    """Hashed tokens of a block: words and one end for each text; pairs with the token before."""

    def __init__(self, docs: pa.RecordBatch) -> None:
        words = B.scan(docs.column("text"), B.NONSPACE)
        n = docs.num_rows
        self.token = np.insert(words.hashes(), words.doc[1:], _END)
        self.at = words.doc + np.arange(n + 1)
        before = np.concatenate([[_BEGIN], self.token[:-1]])
        before[self.at[:-1]] = _BEGIN
        self.pair = B.mix(before * _PAIR + (before >> np.uint64(31)) + self.token)
        self.held_out = id_crc(docs.column("doc_id")) % FOLDS == HELD_OUT
        self.training = np.repeat(~self.held_out, np.diff(self.at))


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs in training."""
    distinct = np.unique(keys)
    own, n = np.unique(keys[training], return_counts=True)
    counts = np.zeros(len(distinct), np.int64)
    counts[np.searchsorted(distinct, own)] = n
    return distinct, counts


def _request(docs: pa.RecordBatch, shards: int) -> dict[int, bytes]:
    t = _Tokens(docs)
    words, pairs = (_counted(keys, t.training) for keys in (t.token, t.pair))
    message = lambda own: [x for (keys, counts), k in zip((words, pairs), own, strict=True) for x in (pack_sorted(keys[k]), pack(planes(counts[k])))]
    return {shard: frames(message(own)) for shard, own in shard_parts(shards, words[0], pairs[0])}


def _respond(own: dict[int, bytes]) -> tuple[dict[int, bytes], list[int]]:
    got = {block: unframe(p) for block, p in own.items()}
    replies: dict[int, list[bytes]] = {block: [] for block in got}
    stats: list[int] = []
    for order in (0, 1):
        each, total = summed([unpack_sorted(p[2 * order]) for p in got.values()], [from_planes(unpack(p[2 * order + 1])) for p in got.values()])
        for block, counts in zip(got, each, strict=True):
            replies[block].append(pack(planes(counts)))
        if order == 0:
            stats = [int(x) for x in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())]
    return {block: frames(p) for block, p in replies.items()}, stats


class Automaton:
    """The part of the model that one block of texts can walk: 0 is the empty context, 1 a text's begin, word w is state w + 2."""

    def __init__(self, counts: np.ndarray, end: int, from_: np.ndarray, word: np.ndarray, pairs: np.ndarray, tokens: int, kinds: int, discount: float) -> None:
        """counts: of words; from_ and word: the words of each pair (from_ -1: begin), pairs: its count; end: the end token's number."""
        known = counts > 0
        p = np.where(known, counts - discount, discount * kinds) / tokens if tokens else np.ones(len(counts))
        context = np.concatenate([[0, counts[end] if len(counts) else 0], counts]).astype(float)
        spread = SPREAD * context**GROWTH
        with np.errstate(divide="ignore", invalid="ignore"):
            #: Weights of the failure arcs, and of the empty context's arcs.
            self.fail = np.where(context > 0, np.log10(spread / (context + spread)), 0.0)
            self.root = np.log10(p)
        #: The state behind each word.
        self.to = np.where(known, np.arange(len(counts)) + 2, 0)
        self.width = len(counts)
        seen = pairs > 0
        state = self.to[from_[seen]] if len(counts) else np.zeros(0, np.int64)
        state[from_[seen] < 0] = 1
        weight = np.log10((pairs[seen] + spread[state] * p[word[seen]]) / (context[state] + spread[state]))
        arc = state * self.width + word[seen]
        order = np.argsort(arc)
        self.arcs, self.weights = arc[order], weight[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The weight of reading each word in each state: its arc's, or the failure arc's and the empty context's."""
        backed_off = self.fail[state] + self.root[word]
        if not len(self.arcs):
            return backed_off
        arc = state * self.width + word
        at = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
        return np.where(self.arcs[at] == arc, self.weights[at], backed_off)

    def path(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The states in which texts' words are read, from left to right; begins marks each text's first word."""
        state = np.concatenate([[1], self.to[words[:-1]]]) if len(words) else np.zeros(0, np.int64)
        state[begins] = 1
        return state

    def walk(self, words: list[int]) -> float:
        """log10 probability of one text, read from its begin."""
        w = np.array(words, np.int64)
        return float(self.step(self.path(w, np.arange(len(w)) == 0), w).sum())


def _finisher(tokens: int, kinds: int, discount: float):
    def done(docs: pa.RecordBatch, replies: list[bytes], _: int) -> pa.RecordBatch:
        t = _Tokens(docs)
        got = [unframe(r) for r in replies]
        words, which = np.unique(t.token, return_inverse=True)
        counts = np.concatenate([from_planes(unpack(p[0])) for p in got])
        distinct, first, pair_of = np.unique(t.pair, return_index=True, return_inverse=True)
        pairs = np.concatenate([from_planes(unpack(p[1])) for p in got])
        assert len(counts) == len(words) and len(pairs) == len(distinct)
        begins = np.zeros(len(t.token), bool)
        begins[t.at[:-1]] = True
        from_ = np.where(begins[first], -1, which[first - 1])
        model = Automaton(counts, int(np.searchsorted(words, _END)), from_, which[first], pairs, tokens, kinds, discount)
        c = counts[which]
        base = np.add.reduceat(np.log10((c + 1) / (tokens + kinds + 1)), t.at[:-1])
        known = np.add.reduceat((c > 0).astype(np.int64), t.at[:-1])
        # Each text is read once; a word's weight depends on the state carried to it and is worked out once for equal pairs.
        state = model.path(which, begins)
        score = np.add.reduceat(model.step(state[first], which[first])[pair_of], t.at[:-1])
        return batch(_SCHEMA, docs.column("doc_id"), t.held_out, np.diff(t.at), known, np.full(docs.num_rows, tokens), base, score)

    return done


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one words), score (the automaton's)."""
    blocks = block_table(docs, "lm-blocks")
    answers = ask(blocks, _request, _respond, "lm-counts")
    tokens, kinds, once, twice = totals(answers, 4)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    return finish(blocks, answers, _finisher(tokens, kinds, discount), _SQL)
