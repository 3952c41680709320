"""Gates over result rows. Each returns the rows that stay and those that go, with the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

Gate = tuple[DataFrame, DataFrame]


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != ""


def _split(rows: DataFrame, keep: Column, reason: str) -> Gate:
    marked = rows.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    return marked.where("_keep").drop("_keep"), marked.where("NOT _keep").drop("_keep").withColumn("reason", F.lit(reason))


def citation_gate(rows: DataFrame, columns: list[str]) -> Gate:
    """Rows that cite, and of whose citations none is valid, go."""
    cited, valid = F.lit(False), F.lit(False)
    for c in columns:
        cite = f"{c} Citation"
        if cite not in rows.columns:
            continue
        own = _filled(cite) & (F.trim(F.col(f"`{cite}`")) != C.AUTO_SNIPPET)
        flags = [F.coalesce(F.col(f"`{x}_citation_valid`"), F.lit(False)) for x in (c, cite) if f"{x}_citation_valid" in rows.columns]
        cited = cited | own
        valid = valid | (own & reduce(lambda a, b: a | b, flags, F.lit(False)))
    return _split(rows, ~cited | valid, "ungrounded_citation")


def strict_gate(rows: DataFrame, least: float = C.STRICT_MINIMUM) -> Gate:
    """Rows whose validation confidence is below a limit, or unknown, go."""
    keep = F.coalesce(F.col("validation_confidence"), F.lit(0.0)) >= least if "validation_confidence" in rows.columns else F.lit(False)
    return _split(rows, keep, "low_validation_confidence")


def source_tier(sources: Column) -> Column:
    llm = F.arrays_overlap(sources, F.array(*[F.lit(s) for s in C.LLM_SOURCES]))
    return F.when(llm, "llm").when(F.size(sources) > 0, "deterministic").otherwise("mixed")


def evidence_gate(rows: DataFrame, columns: list[str], least: dict[str, int] | None = None) -> Gate:
    """Rows with fewer filled cells than their source tier asks for go; adds evidence_cells and source_tier."""
    least = least or C.EVIDENCE_CELLS
    cells = sum((_filled(x).cast("int") for c in columns for x in (c, f"{c} Citation") if x in rows.columns), F.lit(0))
    r = rows.withColumn("evidence_cells", cells).withColumn("source_tier", source_tier(F.coalesce("sources", F.array().cast("array<string>"))))
    need = F.when(F.col("source_tier") == "llm", least["llm"]).when(F.col("source_tier") == "deterministic", least["deterministic"]).otherwise(least["mixed"])
    return _split(r, F.col("evidence_cells") >= need, "insufficient_user_evidence")


def validation_gate(candidates: DataFrame, least: float = C.VALIDATION_MINIMUM) -> Gate:
    """Candidates below the validation limit, and gene-level ones of the lexicon alone without context, go; adds the outcome."""
    lone = (F.size("sources") == 1) & F.array_contains("sources", "deterministic_lexicon") & (F.col("variant") == "")
    c = candidates.withColumn("outcome", F.when(F.col("confidence") < least, "low_confidence").when(lone & ~F.coalesce(F.col("context_supported"), F.lit(False)), "uncorroborated").otherwise("passed"))
    return c.where("outcome = 'passed'"), c.where("outcome <> 'passed'").withColumn("reason", F.col("outcome"))


def all_gates(rows: DataFrame, columns: list[str]) -> Gate:
    """Citation, strict and evidence gate, in this order; drops carry their reason."""
    kept, drops = rows, []
    for gate in (lambda r: citation_gate(r, columns), strict_gate, lambda r: evidence_gate(r, columns)):
        kept, gone = gate(kept)
        drops.append(gone)
    return kept, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), drops)


def row_confidence(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds Confidence (REVIEW, LOW, HIGH, MEDIUM) and Confidence Note by an ordered list of decisions."""
    have = set(rows.columns)
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c in have else F.lit("")
    flag = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(False)) if c in have else F.lit(False)
    either = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    flags = [f"{c}_citation_valid" for c in columns if f"{c}_citation_valid" in have]
    any_valid, any_false = either([flag(c) for c in flags]), either([F.coalesce(~F.col(f"`{c}`"), F.lit(False)) for c in flags])
    all_empty = ~either([text(f"{c} Citation") != "" for c in columns])
    error, source = text("detail_extraction_error"), text("Candidate Source")
    short = F.when(F.length(error) > 80, F.concat(F.substring(error, 1, 80), F.lit("…"))).otherwise(error)
    failed = F.concat(F.when(flag("evidence_backfilled"), "LLM failed; auto-snippet fallback").otherwise("LLM failed; no content"), F.when(error != "", F.concat(F.lit(" ("), short, F.lit(")"))).otherwise(""))
    peers = F.replace(text("co_mentioned_genes"), F.lit(";"), F.lit(", "))
    mixed = (text("evidence_specificity") == "co_mention") & (peers != "")
    failed = F.concat(failed, F.when(mixed, F.concat(F.lit(" | co-mention with "), peers)).otherwise(""))
    figure_only = F.contains(source, F.lit("llm_figure")) & ~either([F.contains(source, F.lit(s)) for s in ("llm_text", "pubtator", "deterministic_lexicon")])
    plain = F.when(~all_empty & ~any_valid, "No citation").otherwise("")
    co = F.concat(F.lit("co-mention with "), peers)
    medium = F.when(flag("evidence_backfilled") & mixed, F.when(plain != "", F.concat(plain, F.lit(" | "), co)).otherwise(co)).otherwise(plain)
    level = lambda name, note: F.struct(F.lit(name).alias("level"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))
    score = F.coalesce(F.col("validation_confidence"), F.lit(0.0)) if "validation_confidence" in have else F.lit(0.0)
    decided = (
        F.when(text("Gene/Group") == "", level("REVIEW", "No genes extracted"))
        .when(text("extraction_mode") == "skeleton", level("REVIEW", failed))
        .when(figure_only, level("REVIEW", "Figure-only gene — no prose citation available"))
        .when(any_false & ~any_valid, level("REVIEW", "Citation text not found in paper"))
        .when(F.contains(text("context_modifications"), F.lit("no_oa_full_text")), level("LOW", "Abstract only"))
        .when(score < C.LOW_CONFIDENCE, level("LOW", "Low confidence"))
        .when((text("Gene Source") == "both") & any_valid, level("HIGH", ""))
        .otherwise(level("MEDIUM", medium))
    )
    return rows.withColumn("_c", decided).withColumns({"Confidence": F.col("_c.level"), "Confidence Note": F.col("_c.note")}).drop("_c")
