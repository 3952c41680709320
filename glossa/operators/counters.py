"""A run's counters, observed while its rows are written: no second pass over the rows.

Distinct papers and genes cannot be counted in an observation, but a row can say whether it is the first of
its paper, or of its paper's gene, where a paper's rows stand together: then they are sums like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .gates import all_gates


def judged(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All rows with the reason for which a gate drops them; '' for those that stay."""
    kept, gone = all_gates(rows, columns)
    return kept.withColumn("reason", F.lit("")).unionByName(gone, allowMissingColumns=True)


def marked(rows: DataFrame, paper: str, gene: Column, quota: Column) -> DataFrame:
    """Rows of a paper side by side, each with first_of_paper, first_of_gene and first_quota_of_paper."""
    own = rows.withColumns({"_gene": F.nullif(F.upper(F.trim(gene)), F.lit("")), "_quota": F.coalesce(quota, F.lit(False))})
    by_gene, by_quota = Window.partitionBy(paper).orderBy(F.col("_gene").asc_nulls_last()), Window.partitionBy(paper).orderBy(F.col("_quota").desc())
    first = F.row_number().over(by_gene) == 1
    gene_first = F.col("_gene").isNotNull() & (first | ~F.col("_gene").eqNullSafe(F.lag("_gene").over(by_gene)))
    return own.withColumns({"first_of_paper": first, "first_of_gene": gene_first, "first_quota_of_paper": F.col("_quota") & (F.row_number().over(by_quota) == 1)})


def write_counted(rows: DataFrame, path: str, reasons: tuple[str, ...], paper: str = "pmid", gene: str = "gene", quota: Column | None = None) -> dict[str, int]:
    """Writes judged rows and gives the counters of what was written, by one job.

    Counters: rows, papers, genes (distinct in each paper), quota_rows, quota_papers, kept, and one for each reason.
    """
    told = Observation("run counters")
    m = marked(rows, paper, F.col(gene), F.lit(False) if quota is None else quota)
    seen = m.observe(
        told, F.count(F.lit(1)).alias("rows"), F.count_if("first_of_paper").alias("papers"), F.count_if("first_of_gene").alias("genes"), F.count_if("_quota").alias("quota_rows"), F.count_if("first_quota_of_paper").alias("quota_papers"),
        F.count_if(F.col("reason") == "").alias("kept"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
    )
    seen.drop("_gene", "_quota", "first_of_paper", "first_of_gene", "first_quota_of_paper").write.mode("overwrite").parquet(path)
    return dict(told.get)
