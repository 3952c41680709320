"""Evidence: where candidates stand in their paper's text.

All of it is expressions that stay in the JVM. Offsets come of cutting a text at
a pattern: the pieces and the matches between them, added up, say where each
match begins. Every expression is per row of a table that carries the text,
never across papers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.text import squeezed

_SPANS = "array<struct<at:int,size:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(term: Column) -> Column:
    """A pattern that stands for a term as it is written."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit("\\E"))


def _whole(pattern: Column, behind: Column | str = "") -> Column:
    """A pattern between non-alphanumeric characters, regardless of case."""
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), pattern, F.lit("(?![A-Za-z0-9])"), F.lit(behind) if isinstance(behind, str) else behind)


def _no_compound(symbol: Column) -> Column:
    """What may not follow a symbol: the rest of a compound's name."""
    out = F.lit("")
    for name, rest in C.COMPOUND_PREFIXES.items():
        out = F.when(F.upper(symbol) == name, f"(?!{rest})").otherwise(out)
    return out


def _patterns(term: Column, symbol: Column | None = None) -> Column:
    """The term as it is; then, from three letters and digits on, these with separators between any two."""
    bar = _no_compound(term if symbol is None else symbol)
    letters = F.regexp_replace(term, "[^A-Za-z0-9]", "")
    spread = F.regexp_replace(letters, "(.)(?=.)", r"$1[\\s\\-_/.()]*")
    return F.array_compact(F.array(_whole(_literal(term), bar), F.when(F.length(letters) >= 3, _whole(spread, bar))))


def _terms(terms: Column | str) -> Column:
    t = F.col(terms) if isinstance(terms, str) else terms
    return F.filter(F.transform(F.coalesce(t, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spans(text: Column, pattern: Column, most: int) -> Column:
    """Place (from 1) and length of the first matches of a pattern."""
    found = F.slice(F.regexp_extract_all(text, pattern, F.lit(0)), 1, most)
    pieces = lambda f: F.zip_with(f, F.slice(F.split(text, pattern), F.lit(1), F.size(f)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    added = lambda a, x: F.struct((a["next"] + x["gap"] + x["size"]).alias("next"), F.array_append(a["out"], F.struct((a["next"] + x["gap"]).alias("at"), x["size"].alias("size"))).alias("out"))
    return _let(found, lambda f: F.when(F.size(f) > 0, F.aggregate(pieces(f), F.struct(F.lit(1).alias("next"), F.array().cast(_SPANS).alias("out")), added, lambda a: a["out"])).otherwise(F.array().cast(_SPANS)))


def _every_span(terms: Column, text: Column, symbol: Column | None = None) -> Column:
    """Spans by term, then pattern, then place."""
    return F.flatten(F.transform(terms, lambda t: F.flatten(F.transform(_patterns(t, symbol), lambda p: spans(text, p, C.SCAN_MAX)))))


def _cut(text: Column, longest: int) -> Column:
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, longest - 3)), F.lit("...")))


def snippet(text: Column, at: Column, size: Column, longest: int = C.SNIPPET_MAX) -> Column:
    """Up to 80 characters before a match, from a sentence's start if there is one, and 220 behind it."""
    lead = F.substring(text, F.greatest(at - 80, F.lit(1)), F.least(F.lit(80), at - 1))
    lead = _let(lead, lambda x: F.when(x.rlike(r"[.!?]\s"), F.regexp_extract(x, r"(?s)[.!?]\s+(.*)$", 1)).otherwise(x))
    return _let(squeezed(F.concat(lead, F.substring(text, at, size + 220))), lambda x: _cut(x, longest))


def first_snippet(terms: Column | str, text: Column | str) -> Column:
    """The first term that the text has, and its snippet: (term, snippet), blank without one."""
    body = _text(text)
    hit = "struct<term:string,at:int,size:int>"

    def place(t: Column, p: Column) -> Column:
        at = lambda i: F.when(i > 0, F.struct(t.alias("term"), i.alias("at"), F.length(F.regexp_substr(F.substring(body, i, F.length(body)), p)).alias("size")).cast(hit))
        return _let(F.regexp_instr(body, p), at)

    # A term is searched for only if none before it stands in the text, and spread only if it does not stand there as it is.
    one = lambda t: F.aggregate(_patterns(t), F.lit(None).cast(hit), lambda found, p: F.when(found.isNotNull(), found).otherwise(place(t, p)))
    first = F.aggregate(_terms(terms), F.lit(None).cast(hit), lambda found, t: F.when(found.isNotNull(), found).otherwise(one(t)))
    return _let(first, lambda h: F.struct(F.coalesce(h["term"], F.lit("")).alias("term"), F.coalesce(snippet(body, h["at"], h["size"]), F.lit("")).alias("snippet")))


def specific_snippet(terms: Column | str, peers: Column | str, text: Column | str) -> Column:
    """A snippet that names no peer, else the first one with the peers that it names: (snippet, specific, peers).

    peers is a list of genes with their terms.
    """
    body, others = _text(text), F.col(peers) if isinstance(peers, str) else peers
    named = lambda s: F.transform(F.filter(others, lambda p: F.exists(_terms(p["terms"]), lambda t: F.rlike(s, _whole(_literal(t))))), lambda p: p["gene"])
    windows = F.transform(_every_span(_terms(terms), body), lambda s: snippet(body, s["at"], s["size"]))
    alone = F.get(F.filter(windows, lambda w: (w != "") & (F.size(named(w)) == 0)), F.lit(0))
    both = F.struct(alone.alias("alone"), first_snippet(terms, text)["snippet"].alias("first"))
    none = F.array().cast("array<string>")
    return _let(both, lambda b: F.struct(F.coalesce(b["alone"], b["first"]).alias("snippet"), b["alone"].isNotNull().alias("specific"), F.when(b["alone"].isNull() & (b["first"] != ""), named(b["first"])).otherwise(none).alias("peers")))


def _sentence(text: Column, at: Column, size: Column) -> Column:
    """The sentence around a match; where no end of one is in sight, 140 characters before and 320 behind it."""
    ends = (".", "!", "?", "\n")
    shortest = lambda xs: F.array_min(F.array(*[F.length(x) for x in xs]))
    before, behind = F.substring(text, F.lit(1), at - 1), F.substring(text, at + size, F.length(text))
    before = _let(before, lambda b: _let(shortest([F.substring_index(b, e, -1) for e in ends]), lambda n: F.right(b, F.when(n < F.length(b), n).otherwise(F.lit(140)))))
    behind = _let(behind, lambda b: _let(shortest([F.substring_index(b, e, 1) for e in ends]), lambda n: F.left(b, F.when(n < F.length(b), n + 1).otherwise(F.lit(320)))))
    return _let(squeezed(F.concat(before, F.substring(text, at, size), behind)), lambda x: _cut(x, 500))


def _context(symbol: Column, around: Column) -> Column:
    """Which kind of biological context words around a mention make, if any."""
    excluded = F.lit(False)
    for name, words in C.SYMBOL_EXCLUSIONS.items():
        excluded = excluded | ((F.upper(F.trim(symbol)) == name) & around.rlike(words))
    signs = F.struct(*[around.rlike(p).alias(n) for n, p in (("result", C.RESULT_SIGNAL), ("pathway", C.PATHWAY_SIGNAL), ("molecular", C.MOLECULAR_SIGNAL))])
    kind = lambda s: F.when(s["result"] & (s["molecular"] | s["pathway"]), "result_context").when(s["pathway"], "pathway_context")
    # A weak context counts only beside a result or a pathway, and these alone decide.
    return F.when(~excluded, _let(signs, kind))


def context_evidence(gene: Column | str, terms: Column | str, text: Column | str) -> Column:
    """Whether some mention stands in biological context: (supported, reason, snippet)."""
    symbol, body, wanted = F.coalesce(F.col(gene) if isinstance(gene, str) else gene, F.lit("")), _text(text), _terms(terms)
    seen = F.transform(_every_span(wanted, body, F.trim(symbol)), lambda s: F.struct(_sentence(body, s["at"], s["size"]).alias("sentence"), squeezed(F.substring(body, F.greatest(s["at"] - 450, F.lit(1)), s["size"] + 450 + F.least(F.lit(450), s["at"] - 1))).alias("window")))
    shown = F.transform(seen, lambda x: F.struct(F.coalesce(F.nullif(x["sentence"], F.lit("")), F.left(x["window"], F.lit(500))).alias("shown"), F.concat_ws(" ", x["sentence"], x["window"]).alias("around")))
    judged = F.transform(shown, lambda x: F.struct(x["shown"].alias("shown"), _context(symbol, x["around"]).alias("reason")))
    answer = lambda ok, reason, said: F.struct(F.lit(ok).alias("supported"), reason.alias("reason"), said.alias("snippet"))
    best = lambda j: _let(F.get(F.filter(j, lambda x: x["reason"].isNotNull()), F.lit(0)), lambda b: F.when(b.isNotNull(), answer(True, b["reason"], b["shown"])).otherwise(answer(False, F.lit("no_strong_deterministic_context"), F.coalesce(F.get(j, F.lit(0))["shown"], F.lit("")))))
    blank = lambda reason: answer(False, F.lit(reason), F.lit(""))
    return F.when(body == "", blank("no_paper_text")).when(F.size(wanted) == 0, blank("no_candidate_terms")).otherwise(_let(judged, best))


def statistical_sentence(terms: Column | str, text: Column | str) -> Column:
    """The shortest sentence near the first term that has one, which names the term and a statistic; cut at 500 characters."""
    body = _text(text)

    def shortest(term: Column) -> Column:
        pattern = F.concat(F.lit("(?i)"), _literal(term))
        near = F.transform(spans(body, pattern, 1 << 20), lambda s: F.substring(body, F.greatest(s["at"] - 600, F.lit(1)), s["size"] + 600 + F.least(F.lit(600), s["at"] - 1)))
        parts = F.flatten(F.transform(near, lambda w: F.split(w, r"(?<=[.!?])\s+")))
        good = F.filter(parts, lambda p: p.rlike(C.STATISTICAL_SIGNAL) & F.rlike(p, pattern) & (F.length(squeezed(p)) >= 20))
        ranked = F.transform(good, lambda p, k: F.struct(F.length(squeezed(p)).alias("n"), k.alias("k"), F.left(squeezed(p), F.lit(500)).alias("s")))
        return F.array_min(ranked)["s"]

    return F.coalesce(F.get(F.array_compact(F.transform(_terms(terms), shortest)), F.lit(0)), F.lit(""))


def ground(candidates: DataFrame, texts: DataFrame, id_column: str = "pmid", hold: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """Candidates (with terms) that their paper's text names, with match, source and snippet; and those that it does not.

    texts has id, text, and optionally original_text (before truncation) and
    captions, in which candidates known from figures only are looked up. hold may
    write the rows that both results are taken from.
    """
    have = set(texts.columns)
    t = candidates.join(texts, id_column, "left")
    figure_only = F.forall("sources", lambda s: s == "llm_figure")
    first = F.when(figure_only, F.col("captions")).otherwise(F.col("text")) if "captions" in have else F.col("text")

    def found(a: Column) -> Column:
        nothing = F.struct(F.lit("").alias("term"), F.lit("").alias("snippet"))
        b = F.when((a["term"] == "") & ~figure_only, first_snippet("terms", F.col("original_text"))).otherwise(nothing) if "original_text" in have else nothing
        source = lambda b: F.when((a["term"] != "") & figure_only, "figure_caption").when(a["term"] != "", "paper_text").when(b["term"] != "", "original_text")
        return _let(b, lambda b: F.when(a["term"] != "", F.struct(a["term"].alias("term"), a["snippet"].alias("snippet"), source(b).alias("source"))).otherwise(F.struct(b["term"].alias("term"), b["snippet"].alias("snippet"), source(b).alias("source"))))

    # Gathered in an array and taken out again, a row's finding is worked out once: filters and fields would each take the whole search along.
    t = t.withColumn("_f", F.explode(F.array(_let(first_snippet("terms", first), found))))
    done = t.withColumns({"grounding_match": F.col("_f.term"), "grounding_snippet": F.col("_f.snippet"), "grounding_source": F.col("_f.source")}).drop("_f", *(have - {id_column}))
    done = hold(done)
    return done.where("grounding_source IS NOT NULL"), done.where("grounding_source IS NULL").withColumn("reason", F.lit("not_grounded_in_text"))


def backfill(rows: DataFrame, texts: DataFrame, column: str, columns: list[str], id_column: str = "pmid") -> DataFrame:
    """Rows without any evidence get a snippet of their paper, specific to the gene if there is one, and flags.

    rows has id, gene, variant, terms and the user columns with their citation twins.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) == ""
    empty = F.lit(True)
    for c in columns:
        empty = empty & blank(c) & blank(f"{c} Citation")
    key = F.upper(F.trim("gene"))
    # All rows of one paper's candidates: bounded by the paper, and gathered once a paper.
    peers = rows.groupBy(id_column).agg(F.collect_list(F.struct(key.alias("gene"), F.col("terms"))).alias("_all"))
    r = rows.join(peers, id_column).join(texts.select(id_column, F.col("text").alias("_text")), id_column, "left")
    r = r.withColumn("_f", F.when(empty, specific_snippet("terms", F.filter("_all", lambda p: p["gene"] != key), "_text")))
    filled = F.coalesce(F.col("_f.snippet"), F.lit("")) != ""
    return r.withColumns({
        column: F.when(filled, F.col("_f.snippet")).otherwise(F.col(f"`{column}`")),
        f"{column} Citation": F.when(filled, C.AUTO_SNIPPET).otherwise(F.col(f"`{column} Citation`")),
        "evidence_backfilled": filled,
        "evidence_specificity": F.when(filled, F.when(F.col("_f.specific"), "gene_specific").otherwise("co_mention")).otherwise(""),
        "co_mentioned_genes": F.when(filled, F.array_join("_f.peers", ";")).otherwise(""),
    }).drop("_all", "_text", "_f")


def fill_missing(rows: DataFrame, columns: list[str], texts: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Blank statistical columns take a statistical sentence; blank conclusions take the key finding or the disease association."""
    r = rows.join(texts.select(id_column, F.col("text").alias("_text")), id_column, "left")
    for c in columns:
        value, cite = F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))), f"{c} Citation"
        if "statistical" in c.lower():
            r = r.withColumn("_s", F.when(value == "", statistical_sentence("terms", "_text")).otherwise(F.lit("")))
            r = r.withColumns({c: F.when(F.col("_s") != "", F.col("_s")).otherwise(F.col(f"`{c}`")), cite: F.when(F.col("_s") != "", F.col("_s")).otherwise(F.col(f"`{cite}`"))}).drop("_s")
        elif "conclusion" in c.lower():
            said = [s for s in ("Key Finding", "Disease Association") if s in rows.columns]
            has = lambda s: F.nullif(F.trim(F.coalesce(F.col(f"`{s}`"), F.lit(""))), F.lit(""))
            picked = F.coalesce(*[F.when(has(s).isNotNull(), F.struct(has(s).alias("v"), F.coalesce(has(f"{s} Citation"), has(s)).alias("c"))) for s in said]) if said else None
            if picked is not None:
                r = r.withColumn("_p", F.when(value == "", picked)).withColumns({c: F.coalesce(F.col("_p.v"), F.col(f"`{c}`")), cite: F.coalesce(F.col("_p.c"), F.col(f"`{cite}`"))}).drop("_p")
    return r.drop("_text")


def named_sections(text: str) -> list[tuple[str, str]]:
    """Sections by known headers, in document order; text before the first one is ``_preamble``."""
    heads = sorted((m.start(), key) for key, p in C.SECTION_HEADERS for m in re.finditer(p, text))
    if not heads:
        return [("_preamble", text)]
    out: dict[str, str] = {"_preamble": text[: heads[0][0]]} if heads[0][0] else {}
    for (start, key), (end, _) in zip(heads, [*heads[1:], (len(text), "")], strict=True):
        out[key] = f"{out[key]}\n\n{text[start:end]}" if key in out else text[start:end]
    return list(out.items())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])))
def named_sections_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "text": t} for n, t in named_sections(x or "")] for x in text])


def _named(name: str):
    return lambda s: s["name"] == name


def fit_context(texts: DataFrame, limit: int = C.CONTEXT_LIMITS["flash"], id_column: str = "pmid") -> DataFrame:
    """Drops sections in a fixed order while a text exceeds 80 % of the limit; the rest is joined in header order.

    Adds original_tokens, tokens, removed (names), text, truncated and warned (still above 95 %).
    """
    from ..functions.text import estimate_tokens

    high, highest = int(limit * C.DROP_SHARE), int(limit * C.WARN_SHARE)
    t = texts.withColumn("original_tokens", estimate_tokens("text")).withColumn("_s", F.when(F.col("original_tokens") > high, named_sections_udf("text")))
    sized = F.transform("_s", lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text"), estimate_tokens(s["text"]).alias("n")))
    t = t.withColumn("_s", sized)
    state = F.struct(F.col("original_tokens").alias("n"), F.array().cast("array<string>").alias("gone"))
    for name in C.SECTION_DROP_ORDER:
        own = F.aggregate(F.filter("_s", _named(name)), F.lit(-1), lambda a, s: s["n"])
        drop = (state["n"] > high) & (own >= 0)
        state = F.struct(F.when(drop, state["n"] - own).otherwise(state["n"]).alias("n"), F.when(drop, F.array_append(state["gone"], F.lit(name))).otherwise(state["gone"]).alias("gone"))
    t = t.withColumn("_d", F.when(F.col("_s").isNotNull(), state))
    order = ["_preamble", *dict.fromkeys(k for k, _ in C.SECTION_HEADERS)]
    kept = F.array_compact(F.concat(*[F.when(~F.array_contains("_d.gone", n), F.transform(F.filter("_s", _named(n)), lambda s: s["text"])).otherwise(F.array().cast("array<string>")) for n in order]))
    return t.withColumns({
        "tokens": F.coalesce("_d.n", "original_tokens"), "removed": F.array_join(F.coalesce("_d.gone", F.array().cast("array<string>")), "+"),
        "text": F.when(F.col("_s").isNotNull(), F.array_join(kept, "\n\n")).otherwise(F.col("text")), "truncated": F.col("_s").isNotNull(),
        "warned": F.coalesce("_d.n", "original_tokens") > highest,
    }).drop("_s", "_d")


def as_terms(*columns: Column | str) -> Column:
    return F.array_compact(F.array(*[F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns]))
