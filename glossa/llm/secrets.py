"""Secret scans: fixed patterns, and password guess costs for values in credential contexts.

The guess cost of a value is the least product of its segments' guesses over
all ways to cut it into dictionary words, dates, repeats, keyboard walks and
brute-force spans, by dynamic programming over the whole value. A value that
would take at least MIN_GUESSES_LOG10 guesses becomes a further span of kind
``value``. Base spans are kept as they are.

Guesses of a segment, as decimal logarithms, n being the value's length:

* a brute-force character: 10 for a digit, 26 for a letter of either case, 33 for another;
* a dictionary word: its rank; twice that if it has capitals, four times if it has digits or signs for letters;
* a date: the years and days of its form;
* a repeat of a unit of at most UNIT characters: the unit by brute force, times the counts that n allows;
* a walk of three keys and more over adjacent keys, or along the alphabet: where it starts, how often it turns, and n.

All of these only look a bounded way back, or carry a running minimum along an
unbroken repeat or walk, so cost is linear in a value's length.

The dictionary is common words of passwords and placeholders, and the corpus's
own words: those of the highest document frequencies, at most DICTIONARY of them,
by rank. One pass counts words over all documents, with partial sums before the
shuffle; the scan is map-only and takes whole texts.

Defined cases: a null text is empty and has no spans; rows are kept one for
one, repeated ids too; very long texts and values are taken whole; without any
document the dictionary is the fixed one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import batch, documents, drop, map_arrow, shared_table

# Fixed patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "value")

#: Words after which a value counts as a credential, and what may stand between.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?\s*(?:[:=]|=>|\bis\b)\s*["']?([^\s"'<>,;]+)""", re.IGNORECASE | re.ASCII)
_KEYWORD = re.compile(r"pass|pwd|secret|token|api|key|credential|auth", re.IGNORECASE | re.ASCII)
MIN_GUESSES_LOG10 = 8.0
#: Most words that the corpus gives, the longest of them, and the longest repeated unit.
DICTIONARY, LONGEST_WORD, UNIT = 20_000, 20, 16

#: Common words of passwords and of placeholders, most frequent first; a word's rank is its guesses.
WORDS = (
    "password 123456 qwerty admin a is i the not this that it in on of to for and or no yes be do go me we you he she "
    "welcome login letmein monkey dragon master hello secret token changeme "
    "default example sample test user root guest public private none null true false string value your key "
    "api my here name pass word access auth service account server database system demo temp foo bar baz "
    "summer winter spring autumn love football baseball shadow sunshine princess superman iloveyou trustno"
).split()
_FIXED = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
_CAPITALS, _SIGNS = math.log10(2), math.log10(4)
_LEET = str.maketrans("@4310$5!7", "aaeiossit")

#: Rows of a keyboard with the place of their first key: keys of one row are one apart, and rows are shifted.
_ROWS = (("1234567890-=", 0.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
_KEYS = {c: (y, x + k) for y, (row, x) in enumerate(_ROWS) for k, c in enumerate(row)}
_SHIFTED = str.maketrans("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _neighbours() -> dict[tuple[str, str], tuple[int, int]]:
    """Pairs of adjacent keys, with the direction from one to the other."""
    found = {}
    for a, (y, x) in _KEYS.items():
        for b, (v, u) in _KEYS.items():
            if (v == y and abs(u - x) == 1) or (abs(v - y) == 1 and abs(u - x) <= 0.75):
                found[a, b] = (v - y, (u > x) - (u < x))
    return found


#: Steps of walks: over the keyboard and along the alphabet; a walk's first key and each turn are guessed.
_KEYBOARD = _neighbours()
_SEQUENCE = {pair: way for a, b in zip(_ALPHABET, _ALPHABET[1:]) for pair, way in (((a, b), 1), ((b, a), -1))}
_WALKS = ((_KEYBOARD, math.log10(len(_KEYS)), math.log10(len(_KEYBOARD) / len(_KEYS))), (_SEQUENCE, math.log10(26), math.log10(2)))

_YEAR, _MONTH, _DAY, _BETWEEN = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", "[-/.]?"
#: Forms of dates, all of which are tried: year first, day first, and a year alone.
_DATES = tuple(re.compile(p, re.ASCII) for p in (_YEAR + _BETWEEN + _MONTH + _BETWEEN + _DAY, _DAY + _BETWEEN + _MONTH + _BETWEEN + _YEAR, _YEAR))
_YEARS, _SEPARATORS = 130, 4


def _date_guesses(length: int) -> float:
    return math.log10(_YEARS * (1 if length == 4 else 365 if length == 8 else 365 * _SEPARATORS))


_BRUTE = {"digit": 1.0, "letter": math.log10(26), "other": math.log10(33)}


def _brute(c: str) -> float:
    return _BRUTE["digit" if c.isdigit() else "letter" if c.isalpha() else "other"]


def guesses_log10(value: str, ranks: dict[str, float] | None = None) -> float:
    """Decimal logarithm of the guesses that the value would take; ranks has the corpus's words with their ranks' logarithms."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few capitals become two characters
        low = value
    ranks = ranks or {}
    rank = lambda w: min(_FIXED.get(w, math.inf), ranks.get(w, math.inf))
    plain, keys, lengths = low.translate(_LEET), low.translate(_SHIFTED), math.log10(max(n, 2))
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _brute(c))
    best = [0.0] + [math.inf] * n
    runs, units = [0] * (UNIT + 1), [{} for _ in range(UNIT + 1)]
    # Of each kind of walk that ends here: its last step, the cost of one of two keys, and of longer ones.
    walks = [(None, math.inf, math.inf)] * len(_WALKS)
    for i in range(n):
        # best[i] is final: all segments that end here begin before. What ends behind character i comes next.
        here = best[i]
        best[i + 1] = min(best[i + 1], here + brute[i + 1] - brute[i])
        for j in range(i + 1, min(n, i + LONGEST_WORD) + 1):
            cost = min(rank(low[i:j]), rank(plain[i:j]) + _SIGNS) + (_CAPITALS if value[i:j] != low[i:j] else 0)
            best[j] = min(best[j], here + cost)
        for m in filter(None, (form.match(value, i) for form in _DATES)) if value[i] in "0123" else ():
            best[m.end()] = min(best[m.end()], here + _date_guesses(m.end() - i))
        for width in range(1, min(UNIT, i) + 1):
            if value[i] != value[i - width]:
                runs[width], units[width] = 0, {}
                continue
            runs[width] += 1
            if runs[width] >= width:
                # The unit that begins two widths back may be the first of a repeat.
                first, own = i + 1 - 2 * width, units[width]
                own[first % width] = min(own.get(first % width, math.inf), best[first] + brute[first + width] - brute[first])
                best[i + 1] = min(best[i + 1], own[first % width] + math.log10(max(2, n // width)))
        for k, (steps, start, turn) in enumerate(_WALKS):
            last, two, more = walks[k]
            way = steps.get((keys[i - 1], keys[i])) if i else None
            if way is None:
                walks[k] = (None, math.inf, math.inf)
                continue
            more = min(two, more) + (0.0 if way == last else turn)
            walks[k] = (way, best[i - 1] + start + lengths, more)
            best[i + 1] = min(best[i + 1], more)
    return best[n]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns by kind."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def value_spans(text: str, least: float = MIN_GUESSES_LOG10, ranks: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Spans of values in credential contexts that would take many guesses."""
    if not _KEYWORD.search(text):
        return []
    return [m.span(1) for m in CONTEXT.finditer(text) if guesses_log10(m[1], ranks) >= least]


def rendered(spans: dict[str, list[tuple[int, int]]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = sorted((a, KINDS.index(k), b, k) for k, own in spans.items() for a, b in own)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in order)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_NONE = hashlib.sha256(b"").hexdigest()


def corpus_ranks(docs: DataFrame, most: int = DICTIONARY) -> dict[str, float]:
    """The words of the highest document frequencies, at most `most`, with their ranks' decimal logarithms.

    Frequencies are counted over all documents. They are grouped by size, a few
    hundred groups in all, which says from which frequency on words fit; only
    those come to the driver. Words of one frequency share a rank.
    """
    words = documents(docs).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{2,{LONGEST_WORD}}}"), F.lit(0)))).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df")).where("df > 1").withColumn("size", F.floor(F.log2("df") * 16))
    df = shared_table(df, "secret-words")
    room, from_ = most, None
    for size, n in sorted(((r["size"], r["n"]) for r in df.groupBy("size").agg(F.count("*").alias("n")).collect()), reverse=True):
        room -= n
        if room < 0:
            break
        from_ = size
    found = sorted(((r["df"], r["word"]) for r in df.where(F.col("size") >= from_).select("df", "word").collect()), reverse=True) if from_ is not None else []
    drop(df)
    ranks, rank, last = {}, 0, None
    for k, (n, word) in enumerate(found):
        rank = rank if n == last else k + 2
        ranks[word], last = math.log10(rank), n
    return ranks


def _scanner(least: float, shared):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for piece in B.chunks(batches):
            out: list[tuple] = []
            for text in piece.column("text").to_pylist():
                base = base_spans(text or "")
                values = value_spans(text or "", least, ranks)
                shown = rendered(base)
                out.append((len(base["assign"]), len(base["access"]), len(base["hex"]), hashlib.sha256(shown.encode()).hexdigest() if shown else _NONE, rendered(base | {"value": values}) if values else shown))
            yield batch(_SCHEMA, piece.column("doc_id"), *map(list, zip(*out, strict=True)))

    return scanned


def secret_scan(docs: DataFrame, least: float = MIN_GUESSES_LOG10) -> DataFrame:
    """Per document row: doc_id, counts of base spans, the digest of the base spans, and all spans."""
    ranks = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs))
    return map_arrow(documents(docs), _scanner(least, ranks), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
