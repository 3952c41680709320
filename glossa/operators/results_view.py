"""The results and history views: search, filter, sort, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key


def any_cell_contains(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of which some cell contains a text, regardless of case."""
    cells = F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or df.columns])
    return df.where(F.contains(F.lower(cells), F.lit(text.lower())))


def in_group(df: DataFrame, group: str | None) -> DataFrame:
    return df if group in (None, "All") else df.where(F.col("`Association Group`") == group)


def jobs_matching(jobs: DataFrame, text: str) -> DataFrame:
    q = F.lit(text.lower())
    return jobs.where(F.contains(F.lower("query"), q) | F.contains(F.lower("status"), q))


def numeric_first(column: str, descending: bool = False) -> list[Column]:
    """Numbers (by leading digits) before texts: a total order where the view's own comparison is not transitive."""
    n = F.regexp_extract(F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))), r"^[-+]?\d*\.?\d+", 0).try_cast("double")
    low = F.lower(F.col(f"`{column}`").cast("string"))
    return [n.desc_nulls_last(), low.desc()] if descending else [n.asc_nulls_last(), low.asc()]


def natural(column: str, descending: bool = False) -> list[Column]:
    key = natural_key(F.col(f"`{column}`").cast("string"))
    return [key.desc() if descending else key.asc()]


def is_quota_row() -> Column:
    error = F.coalesce("detail_extraction_error", F.lit(""))
    return (F.col("extraction_mode") == "skeleton") & (F.contains(error, F.lit("429")) | F.contains(error, F.lit("RESOURCE_EXHAUSTED")) | F.contains(F.lower(error), F.lit("quota")))


def metadata_only(df: DataFrame) -> DataFrame:
    """One row: whether all genes are blank or all rows are metadata only."""
    return df.agg((F.bool_and(F.trim(F.coalesce("gene", F.lit(""))) == "") | F.bool_and(F.col("extraction_mode") == "metadata_only")).alias("metadata_only"))


def with_metadata(primary: DataFrame, meta: DataFrame) -> DataFrame:
    """Primary and metadata rows of one place, by row_id."""
    return primary.join(meta.drop(*[c for c in meta.columns if c in primary.columns and c != "row_id"]), "row_id")
