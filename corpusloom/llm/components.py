"""Connected components of a link table, as Spark joins: contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b), label being the smallest node it reaches.

    Each round points every node to the smallest node of its neighbourhood, follows the
    pointers to their roots by doubling, and contracts the links to links between roots.
    A root is smaller than all that point to it, so nothing can cycle, and every node with
    a link left points elsewhere or is pointed to: the number of roots halves at least.
    Hubs go through an aggregate with map-side combine; pointers are broadcast while they
    are few and joined by shuffle beyond that.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-up")
        n = up.count()
        while True:
            over = up.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            next_ = up.join(maybe_broadcast(over, n, 48), "label").select("node", F.col("higher").alias("label"), (F.col("higher") != F.col("label")).alias("moved"))
            next_ = materialize(next_, "cc-up")
            up = next_.select("node", "label")
            if next_.where("moved").isEmpty():
                break
        steps.append((up, n))
        edges = materialize(_relabel(_relabel(edges, "a", up, n), "b", up, n).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).where(F.lit(False))
    out = steps[0][0]
    for up, n in steps[1:]:
        out = _relabel(out, "label", up, n)
    return out


def _relabel(rows: DataFrame, column: str, up: DataFrame, n: int) -> DataFrame:
    to = maybe_broadcast(up.select(F.col("node").alias("_from"), F.col("label").alias("_to")), n, 48)
    return rows.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
