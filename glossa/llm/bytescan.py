"""Vectorised word scanning and hashing over Arrow string columns.

Words are found on UTF-8 bytes. Every separator class used here is made of
ASCII characters only, so a byte-wise scan cuts exactly where a character-wise
regular expression would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[ord("A") : ord("Z") + 1] = True
ALNUM[128:] = True

#: Word bytes of ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHAIN = np.uint64(0xD6E8FEB86659FD93)
_SLICE = 1 << 20

#: Bytes of text that one step of a scan takes at once; a longer single text makes a step of its own.
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER + np.uint64(seed)) | np.uint64(1)


_BYTES = {0: _byte_values(0), 1: _byte_values(77)}


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _MULTIPLIER)]))


_POWERS = _powers(64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of some texts. data: lower-cased words, each followed by one blank; text d has the words doc[d] to doc[d+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        global _POWERS
        out = np.empty(len(self), np.uint64)
        longest = int((self.end - self.start).max(initial=0))
        if longest > len(_POWERS):
            _POWERS = _powers(longest)
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _SLICE, "right")))
            lo, hi = self.start[a], self.end[b - 1] + 1
            lens = self.end[a:b] - self.start[a:b] + 1
            first = self.start[a:b] - lo
            place = np.arange(hi - lo) - np.repeat(first, lens)
            value = _BYTES[seed][self.data[lo:hi]]
            value[self.end[a:b] - lo] = 0
            place[self.end[a:b] - lo] = 0
            out[a:b] = np.add.reduceat(value * _POWERS[place], first)
            a = b
        return mix(out)

    def text(self, a: int, b: int) -> bytes:
        """The words a to b - 1 with single blanks."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""


def scan(column: pa.Array, word: np.ndarray = ALNUM) -> Words:
    """Finds the words of each text of a column."""
    raw, at = buffers(column)
    inside = word[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    lens = e - s
    end = np.cumsum(lens + 1) - 1
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    gap = np.ones(len(data), bool)
    gap[end] = False
    data[gap] = _LOWER[raw[inside]]
    return Words(data, end - lens, end, np.searchsorted(s, at))


def ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the place of each one's first word."""
    if n == 1:
        return words, np.arange(len(words))
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    out = np.full(len(at), np.uint64(n))
    for k in range(n):
        out = (out * _CHAIN) ^ (out >> np.uint64(29))
        out += words[at + k]
    return mix(out), at


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each piece take at most limit bytes, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
