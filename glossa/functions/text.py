"""Text normalization, splitting and measures, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replaced(text: Column | str, table: dict[str, str]) -> Column:
    """Literal replacements one after the other."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table.items(), _col(text))


def squeezed(text: Column | str) -> Column:
    """White-space runs become one blank; none at the ends."""
    # Single blanks stay as they are: most texts have no others, and each replacement costs.
    return F.trim(F.regexp_replace(_col(text), r"\s(?:\s+|(?<! ))", " "))


def leading_words(text: Column | str, count: int) -> Column:
    """A text up to the end of so many words, as it stands; all of a shorter one."""
    return F.regexp_extract(_col(text), rf"^\s*+(?:\S++\s++){{0,{count - 1}}}+\S*+", 0)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _has_any(c: Column, signs: str) -> Column:
    """Whether a text has one of some signs behind the first 256; most texts have none of those at all, which is told faster."""
    return c.rlike(r"[^\x00-\xFF]") & c.rlike(f"[{signs}]")


def _replaced_if_any(text: Column, sign: str, by: str) -> Column:
    """A sign replaced in texts that have it; others are told faster than searched."""
    return once(text, lambda t: F.when(F.contains(t, F.lit(sign)), F.replace(t, F.lit(sign), F.lit(by))).otherwise(t))


def normalize_slashes(text: Column | str, wide: bool = True) -> Column:
    """Slash look-alikes, LaTeX commands, ``mu`` before units and the micro sign. Texts without their signs are passed through.

    Texts that are not wide have no signs behind the first 256, and are not looked through for them.
    """
    c = _col(text)
    if wide:
        c = once(c, lambda t: F.when(_has_any(t, C.SLASHES), F.translate(t, C.SLASHES, "/" * len(C.SLASHES))).otherwise(t))
    c = once(c, lambda t: F.when(F.contains(t, F.lit("\\")), replaced(t, C.LATEX)).otherwise(t))
    # The word's start is looked at behind its letters: a pattern that begins with a boundary tries one at each place.
    c = once(c, lambda t: F.when(F.contains(t, F.lit("mu")), F.regexp_replace(t, r"mu(?<=\bmu)\s+([gGlLmMuU])", "μ$1")).otherwise(t))
    return _replaced_if_any(c, "µ", "μ")


def normalize_drift(text: Column | str, wide: bool = True) -> Column:
    """Soft hyphens go, then hyphens at line ends; dashes and ligatures become plain. Texts without their signs are passed through; for wide see normalize_slashes()."""
    c = _replaced_if_any(_col(text), "\u00ad", "")
    c = once(c, lambda t: F.when(F.contains(t, F.lit("-\n")), F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")).otherwise(t))
    if not wide:
        return c
    odd = "\u2011\u2013\u2014"
    return once(c, lambda t: F.when(_has_any(t, odd + "".join(C.LIGATURES)), replaced(F.translate(t, odd, "---"), C.LIGATURES)).otherwise(t))


def normalized(text: Column | str) -> Column:
    """normalize_slashes(), then normalize_drift(); whether a text has signs behind the first 256 is asked once for both."""
    each = lambda t, wide: normalize_drift(normalize_slashes(t, wide), wide)
    return once(_col(text), lambda t: F.when(t.rlike(r"[^\x00-\xFF]"), each(t, True)).otherwise(each(t, False)))


def numbers(text: Column | str) -> Column:
    """Standalone integers and decimals, in order."""
    return F.regexp_extract_all(_col(text), F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))


def token_key(text: Column | str) -> Column:
    return F.regexp_replace(F.upper(_col(text)), "[^A-Z0-9]", "")


def gene_key(text: Column | str) -> Column:
    return F.upper(F.trim(F.coalesce(_col(text), F.lit(""))))


def journal_key(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(name)), r"^the\s+", ""), r"[^A-Za-z0-9_\s]", ""))


def strip_tags(text: Column | str) -> Column:
    return squeezed(F.regexp_replace(_col(text), "<[^>]+>", ""))


def format_issn(raw: Column | str) -> Column:
    c = F.upper(F.regexp_replace(F.trim(_col(raw)), "[^0-9Xx]", ""))
    return F.when(F.length(c) == 8, F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 4)))


def word_count(text: Column | str) -> Column:
    c = squeezed(F.coalesce(_col(text), F.lit("")))
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def estimate_tokens(text: Column | str) -> Column:
    return (word_count(text) * F.lit(C.TOKENS_PER_WORD)).cast("int")


def context_limit(model: str = "flash", margin: float = C.SAFETY_MARGIN) -> int:
    return int(C.CONTEXT_LIMITS["flash" if model.lower() == "flash" else "pro"] * margin)


def truncate_words(text: Column | str, token_limit: int) -> Column:
    """The first words that a token limit allows at 0.75 tokens a word."""
    return F.array_join(F.slice(F.split(squeezed(text), " "), 1, int(token_limit / 0.75)), " ")


def sentences(text: Column | str) -> Column:
    # A run of other signs is tried once, from its start and without going back: one that ends in a line break would else be tried from each of its places.
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(?<![^.!?\n])[^.!?\n]++(?:[.!?]++|$)"), F.lit(0))
    return F.filter(F.transform(found, squeezed), lambda s: s != "")


def _cutter(pattern: str):
    # A lambda of two arguments would get the element's place as the second.
    return lambda p: F.split(p, pattern)


def sections(text: Column | str) -> Column:
    """Logical sections: split at known headers, then numbered headers, then blank lines; blank parts go."""
    parts = F.array(_col(text))
    for pattern in (
        r"\n\s*(?:Abstract|Introduction|Methods|Results|Discussion|Conclusion|References)[\s:]+",
        r"\n\s*\d+\.\s+[A-Z][^.\n]+\n",
        r"\n\n+",
    ):
        parts = F.filter(F.flatten(F.transform(parts, _cutter(pattern))), lambda p: squeezed(p) != "")
    return parts


def keep_leading_sections(text: Column | str, token_limit: int) -> Column:
    """Leading sections while their tokens sum to at most the limit; ends at the first that does not fit."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["open"] & (acc["n"] + estimate_tokens(s) <= token_limit)
        return F.struct(F.when(fits, acc["n"] + estimate_tokens(s)).otherwise(acc["n"]).alias("n"), fits.alias("open"), F.when(fits, F.array_append(acc["kept"], s)).otherwise(acc["kept"]).alias("kept"))

    return F.array_join(F.aggregate(sections(text), start, step)["kept"], "\n\n")


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms a (lower-case) text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))


def clean_content(text: Column | str) -> Column:
    """Plain text with its tabs and line breaks; empty when shorter than 100 characters."""
    c = F.coalesce(_col(text), F.lit(""))
    c = F.regexp_replace(F.when(c.rlike(f"[{''.join(C.GREEK)}]"), replaced(c, C.GREEK)).otherwise(c), r"[^\x00-\x7F]+", " ")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \r](?:[ \r]+|(?<=\r))", " "), r"\t{2,}", "\t"), r"\n{3,}", "\n\n")
    c = F.trim(c, F.lit(" \t\n\r\x0b\f"))
    # A condition on a text that is its result too would work it out twice.
    return F.get(F.transform(F.array(c), lambda x: F.when(F.length(x) < 100, "").otherwise(x)), F.lit(0))


def with_content_counts(df: DataFrame, clean: str) -> tuple[DataFrame, dict[str, Column]]:
    """Adds columns with what type and quality of cleaned content count, each once, and tells them: low, academic, words and sentences.

    They are columns of their own, not fields of a struct: the engine puts a struct's fields back where they are used, once for each use.
    """
    df = df.withColumn("_low", F.lower(clean)).withColumn("_academic", hits(F.col("_low"), C.ACADEMIC)).withColumns({"_words": word_count(clean), "_sentences": F.size(F.split(_col(clean), r"[.!?]+"))})
    return df, {n: F.col(f"_{n}") for n in ("low", "academic", "words", "sentences")}


def content_type(clean: Column | str, url: Column | str, counts: dict[str, Column] | None = None) -> Column:
    """One of six labels for cleaned content; with counts of with_content_counts() these are not made again."""
    c, lc, u = _col(clean), F.lower(_col(clean)) if counts is None else counts["low"], F.lower(_col(url))
    academic = hits(lc, C.ACADEMIC) if counts is None else counts["academic"]
    return (
        F.when(c == "", "empty")
        .when(hits(lc, C.NON_CONTENT) > 2, "low_quality")
        .when((F.length(c) > 5000) & (academic >= 3), "full_article")
        .when((F.length(c) > 1000) & (academic >= 2), "substantial_content")
        .when((F.length(c) > 500) & (academic >= 1), "abstract_content")
        .when(F.contains(u, F.lit("pmc")) | F.contains(u, F.lit("articles")), "full_article")
        .otherwise("minimal_content")
    )


def content_quality(text: Column | str, counts: dict[str, Column] | None = None) -> Column:
    """A score from 0 to 1 of length, words, sentences and academic signs; with counts of with_content_counts() these are not made again."""
    c = _col(text)
    lc, n, words = F.lower(c) if counts is None else counts["low"], F.length(c), word_count(c) if counts is None else counts["words"]
    sentence_count = F.size(F.split(c, r"[.!?]+")) if counts is None else counts["sentences"]
    academic = hits(lc, C.ACADEMIC) if counts is None else counts["academic"]
    score = (
        F.when(n > 5000, 0.3).when(n > 2000, 0.2).when(n > 1000, 0.1).otherwise(0.0)
        + F.when(words > 1000, 0.2).when(words > 500, 0.1).otherwise(0.0)
        + F.when(sentence_count > 20, 0.2).when(sentence_count > 10, 0.1).otherwise(0.0)
        + F.least(academic * 0.05, F.lit(0.2))
        - F.when(hits(lc, C.PENALIZED) > 0, 0.3).otherwise(0.0)
    )
    return F.when(F.coalesce(n, F.lit(0)) < 100, 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def is_good_content(clean: Column | str, quality: Column | str, kind: Column | str, error: Column | str) -> Column:
    return (F.length(_col(clean)) >= 1000) & (_col(quality) >= 0.3) & _col(error).isNull() & _col(kind).isin("full_article", "substantial_content")


def normalize_variant(gene: Column | str, variant: Column | str) -> Column:
    """Placeholders become empty; HLA shorthand becomes the full allele where its locus is the gene's."""
    v = F.trim(F.coalesce(_col(variant), F.lit("")))
    v = F.when(F.upper(v).isin(C.EMPTY_VARIANTS), "").otherwise(v)
    g, pattern = gene_key(gene), r"(?i)^(?:HLA[-\s]*)?([A-Z])w?\*?(\d{2,4}(?::\d{2,4}){0,3})$"
    locus = F.upper(F.regexp_extract(v, pattern, 1))
    same = g.startswith("HLA-") & (locus != "") & (locus == F.substring(g, 5, 1))
    return F.when(same, F.concat(F.lit("HLA-"), locus, F.lit("*"), F.regexp_extract(v, pattern, 2))).otherwise(v)


def normalize_placeholder(value: Column | str) -> Column:
    v = F.trim(F.coalesce(_col(value), F.lit("")))
    return F.when(F.lower(v).isin(C.EMPTY_PLACEHOLDERS), "").otherwise(v)


def association_key(gene: Column | str, variant: Column | str) -> Column:
    return F.struct(gene_key(gene).alias("gene"), gene_key(variant).alias("variant"))


def variant_class(variant: Column | str) -> Column:
    """The first nomenclature that a variant follows: a name, ``empty`` or ``no_match``."""
    v = F.trim(_col(variant))
    chain = F.when(F.coalesce(_col(variant), F.lit("")) == "", "empty")
    for name, pattern in C.VARIANT_PATTERNS.items():
        chain = chain.when(v.rlike(pattern), name)
    return chain.otherwise("no_match")


def validation_confidence(valid_gene: Column | str, variant: Column | str) -> Column:
    valid, v = _col(valid_gene), F.coalesce(_col(variant), F.lit(""))
    known = ~variant_class(v).isin("empty", "no_match")
    return F.when(v == "", F.when(valid, 1.0).otherwise(0.0)).otherwise(F.round(F.when(valid, 0.7).otherwise(0.0) + F.when(known, 0.3).otherwise(0.0), 6))


def is_murine_form(label: Column | str, symbol: Column | str) -> Column:
    g = F.trim(_col(label))
    return _col(symbol).isNotNull() & (g != _col(symbol)) & g.rlike(r"^[A-Z](?:[a-z]|.[a-z])")


def normalize_list(items: Column | str) -> Column:
    """Trimmed non-empty items, the first spelling of each regardless of case, in order."""
    kept = F.filter(F.transform(_col(items), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.upper(y) == F.upper(x)), acc).otherwise(F.array_append(acc, x)))


def boundary_pattern(term: str) -> str:
    """A term between characters that are neither letters nor digits."""
    import re

    return rf"(?i)(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])"


def quoted_citation(response: Column | str) -> Column:
    """The citation in a reply: four patterns in order, longer than ten characters."""
    r = F.coalesce(_col(response), F.lit(""))
    found = [F.trim(F.regexp_extract(r, p, 1)) for p in (r"(?i)Citation:\s*[\"']([^\"']+)[\"']", r"(?i)Citation:\s*(.+?)(?:\n|$)", r"(?i)\[Citation:\s*([^\]]+)\]", r'"([^"]{20,})"')]
    return F.coalesce(*[F.when(F.length(f) > 10, f) for f in found], F.lit(""))


def summarize(text: Column | str, most: int = 200, ends: int = 80) -> Column:
    """A long value as head, tail and length; a short one as itself."""
    c = _col(text)
    return F.when(F.length(c) > most, F.struct(F.left(c, F.lit(ends)).alias("head"), F.right(c, F.lit(ends)).alias("tail"), F.length(c).alias("length"))).otherwise(F.struct(c.alias("head"), F.lit(None).cast("string").alias("tail"), F.length(c).alias("length")))


def safe_number(value: Column | str, kind: str = "double") -> Column:
    return F.coalesce(_col(value).try_cast(kind), F.lit(0).cast(kind))


def natural_key(text: Column | str, width: int = 12) -> Column:
    """A sort key that orders digit runs by their numbers, whatever their length: longer ones than the width stand behind, by their number of digits."""
    parts = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    key = lambda n: F.when(F.length(n) <= width, F.lpad(n, width, "0")).otherwise(F.concat(F.lit("9" * width + ":"), F.lpad(F.length(n).cast("string"), 8, "0"), n))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), key(number(p))).otherwise(p)), "")
