"""Connected components of an edge table, by contraction.

Each round every vertex points at its least neighbour, edges are redrawn between
the vertices pointed at, and loops vanish.  A vertex that is not the least of its
neighbourhood is merged in each round, so rounds grow with the logarithm of the
vertices.  Only minima per vertex are computed: no neighbourhood is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every vertex of edges (a, b), longs. Roots are the same for one component."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")))
        # One jump, so that chains shrink faster.
        jump = stored(least.join(least.select(F.col("v").alias("v2"), F.col("p").alias("p2")), F.col("p") == F.col("v2"), "left").select("v", F.coalesce("p2", "p").alias("p")))
        if labels is None:
            labels = stored(jump.select(F.col("v").alias("node"), F.col("p").alias("root")))
        else:
            labels = stored(labels.join(jump, F.col("root") == F.col("v"), "left").select("node", F.coalesce("p", "root").alias("root")))
        one = edges.join(jump, F.col("a") == F.col("v")).select(F.col("p").alias("a"), "b")
        two = one.join(jump, F.col("b") == F.col("v")).select("a", F.col("p").alias("b"))
        edges = stored(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after some roots, and nodes without a label so far, have been merged: (node, root) of each."""
    moved = merged.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    old = labels.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return stored(old.union(new.select("node", "root")))
