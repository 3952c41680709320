"""Scores of abstracts, papers and rows."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp_score(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), half_up(x)))


@dataclass(frozen=True)
class Signals:
    """What an abstract is scored by; the defaults are the fixed values."""

    keywords: dict[str, int] = field(default_factory=lambda: dict(C.GENETIC_KEYWORDS))
    negatives: tuple[str, ...] = tuple(C.NEGATIVE_KEYWORDS)
    phrases: tuple[str, ...] = tuple(C.GENE_PHRASES)
    context: tuple[str, ...] = tuple(C.MOLECULAR_CONTEXT)
    symbols: tuple[str, ...] = tuple(C.KNOWN_SYMBOLS)
    not_symbols: tuple[str, ...] = tuple(C.NOT_SYMBOLS)
    variants: tuple[str, ...] = tuple(C.VARIANT_SIGNS)
    #: Whether only ASCII letters, digits and the underscore are parts of words, as in the queries' SQL; in the published form all letters are.
    ascii_words: bool = False


def _gates(terms, size: int = 3) -> dict[str, str]:
    """For each term a few letters of it that as many terms as possible have: a text without them is not searched for any of these terms."""
    parts = {t: sorted({t[k : k + size] for k in range(max(1, len(t) - size + 1))}) for t in terms}
    out: dict[str, str] = {}
    while left := [t for t in parts if t not in out]:
        counts = Counter(g for t in left for g in parts[t])
        best = max(sorted(counts), key=counts.get)
        out |= {t: best for t in left if best in parts[t]}
    return out


def _found(text: Column, terms, gates: dict[str, str], opened: Column) -> Column:
    """Which of the terms a text contains, in their order; opened tells by place which of the gates it contains."""
    place = {g: k for k, g in enumerate(dict.fromkeys(gates.values()))}
    return F.filter(F.array(*[F.when(F.get(opened, F.lit(place[gates[t]])) & F.contains(text, F.lit(t)), F.lit(t)) for t in terms]).cast("array<string>"), lambda x: x.isNotNull())


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


#: The end of a word of ASCII letters, digits and underscores.
_ASCII_BOUND = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def _ascii_bounds(pattern: str) -> str:
    r"""A pattern whose \b knows ASCII words only; the engine's own \b takes other letters as parts of words, its \w does not."""
    return re.sub(r"((?<!\\)(?:\\\\)*)\\b", lambda m: m[1] + _ASCII_BOUND, _bound_behind(pattern, r"(?<!\w{})"))


def _bound_behind(pattern: str, behind: str = r"(?<=\b{})") -> str:
    r"""A pattern that begins with \b and letters or a class of letters looks at the boundary behind these: few places get so far, and matches are the same."""
    m = re.match(r"\\b([A-Za-z]|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[A-Za-z])+\])([A-Za-z]*)(?![?*+{A-Za-z])", pattern)
    if not m or "|" in pattern:
        return pattern
    first = m[1] + m[2]
    return first + behind.format(first) + pattern[m.end() :]


def with_abstract_parts(papers: DataFrame, signals: Signals | None = None, distinct_variants: bool = True, name: str = "parts") -> DataFrame:
    """Adds the parts of an abstract's score: a struct of score, positive, negative, symbols, n_symbols, n_variants and context.

    Both published forms are here: one counts different variant mentions, the
    other (distinct_variants=False) every mention. Null where the abstract is
    null or has fewer than 100 characters. Each text is lower-cased and searched
    once: the steps are columns of their own, since an expression that repeats
    inside a large sum is evaluated again for each term.
    """
    s = signals or Signals()
    p = papers.withColumn("_raw", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "abstract"))
    p = p.withColumn("_low", F.lower("_raw"))
    raw, low = F.col("_raw"), F.col("_low")
    allowed = lambda x: ~x.isin(list(s.not_symbols))
    bounded = _ascii_bounds if s.ascii_words else _bound_behind
    if all(re.fullmatch("[A-Z][A-Z0-9]*", x) for x in s.symbols):
        # Both kinds of symbol are whole tokens of capitals and digits: one pass finds the tokens.
        p = p.withColumn("_tokens", _all(raw, r"[A-Z](?<!\w[A-Z])[A-Z0-9]*+(?!\w)" if s.ascii_words else r"[A-Z](?<=\b[A-Z])[A-Z0-9]*\b"))
        coded = F.filter("_tokens", lambda x: x.rlike(C.SYMBOL_PATTERN) & allowed(x))
        known = F.filter("_tokens", lambda x: x.isin(list(s.symbols)) & allowed(x))
    else:
        p = p.withColumn("_tokens", F.lit(None))
        coded, known = F.filter(_all(raw, bounded(C.SYMBOL_PATTERN)), allowed), F.filter(_all(raw, bounded(r"\b(?:" + "|".join(map(re.escape, s.symbols)) + r")\b")), allowed)
    gates = _gates([*s.keywords, *s.negatives, *s.context, *s.phrases])
    p = p.withColumns({"_symbols": F.concat(coded, known), "_variants": F.concat(*[_all(F.col("abstract"), bounded(v)) for v in s.variants]), "_opened": F.array(*[F.contains(low, F.lit(g)) for g in dict.fromkeys(gates.values())])})
    found = lambda terms: _found(low, terms, gates, F.col("_opened"))
    p = p.withColumns({"_positive": found(s.keywords), "_negative": found(s.negatives), "_context": F.size(found(s.context)) > 0, "_phrases": F.size(found(s.phrases))})
    weight = F.create_map(*[F.lit(x) for kv in s.keywords.items() for x in kv])
    p = p.withColumns({"_n": F.size(F.array_distinct("_symbols")), "_v": F.size(F.array_distinct("_variants") if distinct_variants else F.col("_variants")), "_w": F.aggregate("_positive", F.lit(0), lambda a, k: a + weight[k])})
    score = F.col("_w") - C.NEGATIVE_PENALTY * F.size("_negative") + 2 * F.col("_n") + 3 * F.col("_v") + F.col("_phrases")
    score = score - F.when((F.col("_n") > 0) & ~F.col("_context"), F.col("_n") + 3).otherwise(0)
    parts = F.struct(
        score.cast("int").alias("score"), F.col("_positive").alias("positive"), F.col("_negative").alias("negative"), F.slice("_symbols", 1, 10).alias("symbols"),
        F.col("_n").alias("n_symbols"), F.col("_v").alias("n_variants"), F.col("_context").alias("context"),
    )
    used = ["_raw", "_low", "_tokens", "_symbols", "_variants", "_opened", "_positive", "_negative", "_context", "_phrases", "_n", "_v", "_w"]
    return p.withColumn(name, F.when(F.length("abstract") >= C.SHORTEST_ABSTRACT, parts)).drop(*used)


def screening_confidence(score: Column) -> Column:
    return F.when(score > 0, F.least(score / C.FULL_SCREENING_SCORE, F.lit(1.0))).otherwise(0.0)


def tier(score: Column) -> Column:
    return reduce(lambda c, t: c.when(score >= t[0], t[1]), C.TIERS[1:], F.when(score >= C.TIERS[0][0], C.TIERS[0][1])).otherwise("none")


def quartile_score(quartile: Column, default: int = C.UNRANKED_SCORE) -> Column:
    return reduce(lambda c, kv: c.when(quartile == kv[0], kv[1]), list(C.QUARTILE_SCORES.items())[1:], F.when(quartile == "Q1", C.QUARTILE_SCORES["Q1"])).otherwise(default)


def composite_score(citations: Column, quality: Column) -> Column:
    capped = F.least(citations / C.CITATIONS_CAP * 100, F.lit(100.0))
    return half_up(capped * C.IMPACT_WEIGHTS[0] + quality * C.IMPACT_WEIGHTS[1])


def genetics_signal(score: Column) -> Column:
    return clamp_score(F.greatest(F.coalesce(score, F.lit(0)), F.lit(0)) / C.GENETICS_CAP * 100)


def recommendation(genetics: Column, impact: Column) -> Column:
    # The weights are decimals, so that halves are exact in every engine.
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor((genetics * 65 + impact * 35 + 50) / 100).cast("int")))


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def low_relevance_reason(types: Column, score: Column, symbols: Column, context: Column, excluded: list[str] | None = None) -> Column:
    """Why a paper looks weak, the first of an ordered list."""
    review = F.arrays_overlap(types, F.array(*[F.lit(x) for x in (excluded or ["Review", "Systematic Review", "Meta-Analysis"])]))
    return (
        F.when(review, "review_type").when(score.isNull(), "unscored").when(score <= 0, "no_genetic_content")
        .when(F.size(symbols) == 0, "no_gene_symbols").when(~context, "no_molecular_context").otherwise("weak_signal")
    )
