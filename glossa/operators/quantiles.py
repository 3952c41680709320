"""Exact quantiles of groups of any size.

`median` and `percentile` hold a group's values in one task. Here values are dealt to sorted ranges, so a group of
any size lies in as many ranges as it needs; the rows that a group has in each range say in which one, and at which
place, a rank stands; and only the rows at those places are read. Two counts and one or two rows a quantile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared_folder

_SHIFT = 33
#: Values of a range, about.
RANGE_ROWS = 2_000_000


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def quantiles(rows: DataFrame, by: list[str], value: str, linear: dict[str, float] | None = None, nearest: dict[str, float] | None = None) -> DataFrame:
    """Per group: n values, and each named quantile, by linear interpolation between the two ranks around it (type 7), or the value at its nearest rank above.

    Null values do not count; NaN is greater than every number; a group without values has nulls. Null groups are groups.
    """
    linear, nearest = linear or {}, nearest or {}
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "quantiles")
    v = rows.select(*by, F.col(value).cast("double").alias("v"))
    path = f"{folder}/values"
    v.write.parquet(path)
    v = spark.read.schema(v.schema).parquet(path)
    known = v.where("v IS NOT NULL")
    n_ranges = max(spark.sparkContext.defaultParallelism, known.count() // RANGE_ROWS + 1)
    # Equal values are told apart by the row's own number, so that not even they all fall into one range.
    order = [*[F.col(c) for c in by], F.col("v"), F.col("_row")]
    placed = known.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    path = f"{folder}/placed"
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    parts = placed.groupBy(*by, F.shiftright("_at", _SHIFT).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_n").over(w)})
    n = F.col("n")
    # A quantile's ranks from 0, and how much the upper one weighs.
    asked = [F.struct(F.lit(name).alias("name"), F.floor((n - 1) * q).alias("rank"), ((n - 1) * q - F.floor((n - 1) * q)).alias("upper")) for name, q in linear.items()]
    asked += [F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(n * q) - 1, F.lit(0)).alias("rank"), F.lit(0.0).alias("upper")) for name, q in nearest.items()]
    ranks = parts.select(*by, "n", "_first", "_before", "_n", F.explode(F.array(*asked)).alias("q")).select("*", F.explode(F.array(F.struct(F.col("q.rank").alias("r"), (1 - F.col("q.upper")).alias("weight")), F.struct((F.col("q.rank") + 1).alias("r"), F.col("q.upper").alias("weight")))).alias("x"))
    here = ranks.where((F.col("x.weight") > 0) & (F.col("x.r") >= F.col("_before")) & (F.col("x.r") < F.col("_before") + F.col("_n")))
    wanted = here.select(*by, (F.col("_first") + F.col("x.r") - F.col("_before")).alias("_at"), F.col("q.name").alias("_name"), F.col("x.weight").alias("_weight"))
    met = wanted.join(placed.select("_at", "v"), "_at")
    got = met.groupBy(*by).agg(*[F.sum(F.when(F.col("_name") == name, F.col("_weight") * F.col("v"))).alias(name) for name in [*linear, *nearest]])
    sizes = v.groupBy(*by).agg(F.count("v").alias("n"))
    return sizes.alias("s").join(got.alias("g"), _same("s", "g", by), "left").select(*[F.col(f"s.{c}") for c in by], "n", *[F.col(f"g.{name}") for name in [*linear, *nearest]])


def describe_any_size(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """What describe() gives, for groups of any size: count, mean, median, sd, min, max and nearest-rank p95; 0 for what a group lacks."""
    v, zero = F.col(value).cast("double"), F.lit(0.0)
    sums = long.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    ranks = quantiles(long, by, value, {"median": 0.5}, {"p95": 0.95})
    both = sums.alias("s").join(ranks.alias("r"), _same("s", "r", by))
    return both.select(*[F.col(f"s.{c}") for c in by], "s.count", *[F.coalesce(c, zero).alias(c) for c in ("mean", "median", "sd", "min", "max", "p95")])
