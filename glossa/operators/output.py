"""Result rows: merging, variant aggregation, sorting, column choice, audits and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import gene_key, normalize_variant
from .candidates import association_group


def unique_names(columns: list[str]) -> list[str]:
    """Names with " (2)", " (3)" behind repeats."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        seen[c] = seen.get(c, 0) + 1
        out.append(c if seen[c] == 1 else f"{c} ({seen[c]})")
    return out


def with_unique_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def safe_user_columns(wanted: dict[str, str], reserved: list[str] | None = None) -> dict[str, str]:
    """User columns, renamed where they meet a reserved or used name."""
    taken, out = set(reserved or C.RESERVED_COLUMNS), {}
    for raw, description in wanted.items():
        key = (raw or "").strip()
        if not key:
            continue
        name, k = key if key not in taken else f"User: {key}", 2
        while name in taken:
            name, k = f"{key} ({k})", k + 1
        out[name] = description
        taken.add(name)
    return out


def user_output_columns(wanted: list[str], available: list[str]) -> list[str]:
    """Requested columns with their citation twins, those that are there, each once."""
    names = [x for raw in wanted if (c := (raw or "").strip()) for x in ((c,) if c.endswith(" Citation") else (c, f"{c} Citation"))]
    return list(dict.fromkeys(x for x in names if x in set(available)))


def merge_duplicates(rows: DataFrame, columns: list[str], key: list[str], position: str = "position") -> DataFrame:
    """One row for each paper, gene and variant: the first non-empty value of each column, in the first row's place."""
    r = rows.withColumn("variant", normalize_variant("gene", "variant")).withColumns({"_g": gene_key("gene"), "_v": gene_key("variant")})
    filled = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    first = [F.coalesce(F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col(position))), F.lit("")).alias(c) for c in columns]
    return r.groupBy(*key, "_g", "_v").agg(F.min_by("gene", position).alias("gene"), F.min_by("variant", position).alias("variant"), F.min(position).alias(position), *first).drop("_g", "_v")


def aggregate_variants(rows: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Rows that agree in paper, gene and user fields become one with their variants, distinct and sorted, joined by "; "; nulls are a group.

    Rows without gene stay as they are.
    """
    rest = [c for c in rows.columns if c not in (*keys, "variant", position)]
    q = lambda c: F.col(f"`{c}`")
    full = rows.where(gene_key("gene") != "")
    variants = F.array_join(F.array_sort(F.collect_set(F.when(F.trim(F.coalesce("variant", F.lit(""))) != "", F.col("variant")))), "; ")
    full = full.groupBy(*[q(c) for c in keys]).agg(variants.alias("variant"), F.min(position).alias(position), *[F.min_by(q(c), position).alias(c) for c in rest])
    return full.unionByName(rows.where(gene_key("gene") == "").select(*[q(c) for c in full.columns]))


def with_group(rows: DataFrame) -> DataFrame:
    return rows if "Association Group" in rows.columns else rows.withColumn("Association Group", association_group("`Association Type`" if "Association Type" in rows.columns else F.lit("")))


def final_order(confidence_rank: bool = False) -> list:
    """Group order, then confidence (as text, or by rank), paper and gene."""
    place = reduce(lambda c, g: c.when(F.col("`Association Group`") == g[1], g[0]), list(enumerate(C.GROUP_ORDER))[1:], F.when(F.col("`Association Group`") == C.GROUP_ORDER[0], 0)).otherwise(99)
    level = F.when(F.col("Confidence") == "HIGH", 0).when(F.col("Confidence") == "MEDIUM", 1).when(F.col("Confidence") == "LOW", 2).otherwise(3) if confidence_rank else F.col("Confidence")
    return [place, level, F.col("PMID"), F.col("`Gene/Group`")]


def primary_columns(user_columns: list[str], available: list[str]) -> list[str]:
    wanted = [
        "Gene", "Variant", *user_output_columns(user_columns, available), "Confidence", "Confidence Note", "Association Group", "Association Type",
        "Original Paper Mention", "Grounding Match", "Grounding Source", "Normalization Rule", "extraction_mode", "evidence_backfilled",
        "evidence_specificity", "context_modifications", "PMID", "Title", "Year", "Journal", "Authors", "Citations", "DOI",
    ]
    return list(dict.fromkeys(c for c in wanted if c in set(available)))


def split_output(rows: DataFrame, user_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Primary and metadata tables in one order, tied by row_id."""
    from .ordering import with_ordinal

    r = with_ordinal(with_group(rows), [*final_order(), F.col("`Variant Name`")], "row_id")
    clean = r.withColumnsRenamed({k: v for k, v in C.RENAMED_COLUMNS.items() if k in r.columns})
    q = lambda cs: [F.col(f"`{c}`") for c in cs]
    keys = [c for c in ("PMID", "Gene/Group", "Variant Name") if c in r.columns]
    return clean.select("row_id", *q(primary_columns(user_columns, clean.columns))), r.select("row_id", *q(keys), *q(c for c in r.columns if c not in (*keys, "row_id")))


def write_results(rows: DataFrame, user_columns: list[str], path: str) -> dict[str, str]:
    """Writes primary and metadata CSV and primary JSON Lines under a path; returns where."""
    primary, meta = split_output(rows, user_columns)
    where = {k: f"{path.rstrip('/')}/{k}" for k in ("primary_csv", "metadata_csv", "primary_json")}
    primary.orderBy("row_id").drop("row_id").write.mode("overwrite").option("header", True).csv(where["primary_csv"])
    meta.orderBy("row_id").drop("row_id").write.mode("overwrite").option("header", True).csv(where["metadata_csv"])
    primary.orderBy("row_id").drop("row_id").write.mode("overwrite").json(where["primary_json"])
    return where


def emitted_summary(rows: DataFrame, key: str = "pmid") -> DataFrame:
    """Per paper: emitted rows, non-blank associations, and a map of group counts."""
    r = rows.withColumn("_group", F.coalesce(F.nullif(F.trim("association_group"), F.lit("")), association_group("association_type")))
    named = gene_key("gene") != ""
    per = r.groupBy(key, "_group").agg(F.count("*").alias("rows"), F.count_if(named).alias("n"))
    return per.groupBy(key).agg(
        F.sum("rows").alias("emitted_rows"), F.sum("n").alias("associations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("_group", "n"))))).alias("group_counts"),
    )


def candidate_audit(papers: DataFrame, rows: DataFrame, key: str = "pmid") -> DataFrame:
    """Papers (with candidate_count and their own emitted_rows) with what was emitted in the end, which wins over their own count."""
    return papers.withColumnRenamed("emitted_rows", "_own").join(emitted_summary(rows, key), key, "left").withColumns({
        "emitted_rows": F.coalesce("emitted_rows", "_own", F.lit(0)), "associations": F.coalesce("associations", F.lit(0)),
    }).drop("_own")


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("papers"), F.sum(F.coalesce("candidate_count", F.lit(0))).alias("total_candidates"), F.sum("emitted_rows").alias("total_emitted_rows"), F.sum("associations").alias("total_associations"))


def minimal_rows(papers: DataFrame, mode: str = "metadata_only") -> DataFrame:
    """A row without gene for each paper."""
    return papers.withColumns({"gene": F.lit(""), "variant": F.lit(""), "extraction_mode": F.lit(mode)})


def details_or_skeletons(candidates: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with their extracted fields, or as skeletons with the error."""
    r = replies.withColumn("_has", F.lit(True))
    return candidates.join(r, keys, "left").withColumn("extraction_mode", F.when(F.col("_has") & (F.coalesce("error", F.lit("")) == ""), "llm").otherwise("skeleton")).drop("_has")


def cancelled(all_ids: DataFrame, done: DataFrame) -> DataFrame:
    """What a cancelled run did not reach."""
    return all_ids.join(done, "pmid", "left_anti").withColumn("status", F.lit("CANCELLED"))
