"""Connected components of pairs, by alternating stars.

Each round points every node at the least of its neighbours, once through its larger and once through its smaller
ones, which halves long chains; after a number of rounds that grows with the logarithm of the longest one, every
node points at the least node of its component. Each round's pairs are written to the shared folder, so lineage
stays short and lost executors cost a round at most. Only sums come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import shared_folder


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of pairs (a, b) of any comparable type; a pair of one node with itself is its component.

    Pairs with a null are left out; repeated pairs and either direction make no difference.
    """
    spark = pairs.sparkSession
    folder = shared_folder(spark, "components")
    every = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    path = f"{folder}/given"
    every.write.parquet(path)
    given = spark.read.schema(every.schema).parquet(path)
    now, before, k = given.where("a <> b"), None, 0
    while True:
        step = _small_star(_large_star(now))
        path, k = f"{folder}/round-{k}", k + 1
        step.write.parquet(path)
        now = spark.read.schema(step.schema).parquet(path)
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if told == before:
            break
        before = told
    nodes = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
