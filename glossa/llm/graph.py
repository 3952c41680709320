"""Connected components of a graph given by its edges, with no step that gathers a component in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, shared_table


def components(edges: DataFrame) -> DataFrame:
    """Per node that has an edge: node, component (the smallest node that can be reached).

    edges has the columns u and v, of any order and with repeats; loops count for nothing.

    First every node keeps one edge, to its smallest neighbour among the smaller
    ones; its other neighbours are joined to that one instead, until no node has
    more than one. Then each node's parent is replaced by its parent's parent
    until nothing changes. The first part groups by the larger end, so a node
    with very many neighbours is, as the smaller end, never gathered.
    """
    e = shared_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        parents = shared_table(e.groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("c")), "parents")
        if not parents.where("c > 1").limit(1).count():
            break
        rest = e.join(parents.where("c > 1"), "u").where("v > p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        fewer = shared_table(parents.select("u", F.col("p").alias("v")).union(rest).distinct(), "edges")
        drop(e, parents)
        e = fewer
    drop(e)
    tree = kept = parents
    while True:
        up = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        new = shared_table(tree.select("u", "p").join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "tree")
        drop(kept)
        tree = kept = new
        if not new.where("moved").limit(1).count():
            break
    return tree.select(F.col("u").alias("node"), F.col("p").alias("component")).union(tree.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a boolean matrix: the number of the component of each, or one of its own."""
    q, m = linked.shape
    label = np.arange(q + m)
    rows, columns = np.nonzero(linked)
    while len(rows):
        before = label.copy()
        low = np.minimum(label[rows], label[q + columns])
        np.minimum.at(label, rows, low)
        np.minimum.at(label, q + columns, low)
        label = label[label]
        if (label == before).all():
            break
    return label[:q], label[q:]
