"""Token ids of whole columns through the tokenizers library, each distinct run of text once.

Both vocabularies' pre-tokenisers cut before a white-space run that follows
other text, and before ASCII punctuation that follows an ASCII letter or digit;
nothing they do looks across such a place. So a text is split into runs there,
distinct runs are encoded by the library, and the ids are put together again;
ids equal those of the whole text.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from . import bytescan as B

#: Runs that a worker remembers between batches.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 2 << 20
#: Runs that are encoded in one text, between special tokens, which the library cuts out first.
TOGETHER = 512


def tokenizer_json(path: str) -> str:
    """The vocabulary file's text, which is broadcast: its size is that of a vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def broadcast_tokenizer(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(tokenizer_json(path))
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[i for i in range(128) if chr(i).isalnum()]] = True


class Encoder:
    def __init__(self, definition: str) -> None:
        # Spark runs a task a core: the library's own threads would only add memory and switching.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.fence = special[0] if special else None
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.lens, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, runs: list[str]) -> None:
        """Encodes new runs; keys are sorted."""
        if len(self.keys) + len(keys) > REMEMBERED:
            self._clear()
        new, lens = self._encode_runs(runs)
        at = len(self.ids) + np.cumsum(lens) - lens
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.lens = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.lens, place, lens)
        self.ids = np.concatenate([self.ids, new])

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs and how many each has."""
        if self.fence is None or any("<|" in r and self.fence[1] in r for r in runs):
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.fromiter(map(len, got), np.int64, len(got))
        mark, fence = self.fence
        texts = [fence.join(runs[i : i + TOGETHER]) + fence for i in range(0, len(runs), TOGETHER)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.flatnonzero(ids == mark)
        return ids[ids != mark], np.diff(ends, prepend=-1) - 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts, and where each text's ids begin (and the last end)."""
        raw, at = B.buffers(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        blank = ~B.NONSPACE[raw]
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        if b"<|" not in raw.tobytes():
            # Punctuation behind a letter or digit begins a new piece in both vocabularies' patterns; special tokens are left whole.
            cut[1:] |= _PUNCTUATION[raw[1:]] & _PLAIN[raw[:-1]]
        cut[at[:-1][np.diff(at) > 0]] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(raw))
        h = _run_hashes(raw, s, e)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            known = self.keys[place] == distinct
        if not known.all():
            if len(self.keys) + int((~known).sum()) > REMEMBERED:
                self._clear()
                known[:] = False
            body, new = raw.tobytes(), np.flatnonzero(~known)
            self._learn(distinct[new], [body[a:b].decode() for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
        place = np.searchsorted(self.keys, distinct)[which]
        lens = self.lens[place]
        ids = self.ids[np.repeat(self.at[place], lens) + B.ragged(lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ids, ends[np.searchsorted(s, at)]


def _run_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs that cover raw without gaps."""
    longest = int((e - s).max(initial=0))
    if longest > len(B._POWERS):
        B._POWERS = B._powers(longest)
    out, a = np.empty(len(s), np.uint64), 0
    while a < len(s):
        b = max(a + 1, int(np.searchsorted(e, s[a] + (1 << 20), "right")))
        first = s[a:b] - s[a]
        place = np.arange(e[b - 1] - s[a]) - np.repeat(first, e[a:b] - s[a:b])
        out[a:b] = np.add.reduceat(B._BYTES[0][raw[s[a] : e[b - 1]]] * B._POWERS[place], first)
        a = b
    return B.mix(out + (e - s).astype(np.uint64))


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts an end id behind each text's ids."""
    n = len(at) - 1
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(n + 1)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
