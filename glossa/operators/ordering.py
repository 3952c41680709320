"""Ordinals over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_folder

_SHIFT = 33


def with_ordinal(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds 1, 2, ... along a total order.

    Rows are range-partitioned and sorted; each partition's row count is all that
    meets in one place. The sorted rows are written to the shared folder, since
    ranges are drawn from a sample and have to be the same for the counts and for
    the result, whatever executors are lost in between.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "ordered")
    s = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    s.write.parquet(path)
    s = spark.read.schema(s.schema).parquet(path)
    sizes = s.groupBy(F.shiftright("_at", _SHIFT).alias("p")).agg(F.count("*").alias("n")).collect()
    before, first = 0, []
    for r in sorted(sizes):
        first.append((r["p"], before))
        before += r["n"]
    if not first:
        return s.withColumn(name, F.col("_at")).drop("_at")
    # One entry a partition.
    offset = F.create_map(*[F.lit(x) for pair in first for x in pair])[F.shiftright("_at", _SHIFT)]
    return s.withColumn(name, offset + F.col("_at").bitwiseAND((1 << _SHIFT) - 1) + 1).drop("_at")
