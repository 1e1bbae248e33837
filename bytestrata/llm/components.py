"""Connected components by contraction, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``).

    Each round hooks every node onto its smallest neighbour, flattens those chains by
    pointer doubling and contracts the edges to the roots, so rounds are logarithmic in
    the number of nodes. Only a few counts reach the driver. A hot node costs one
    aggregated row per task. Self links and repeated links change nothing; no edges, no rows.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    levels = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = cut(both.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("node"), F.least("a", "up").alias("up")))
        while True:
            above = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
            tree = cut(tree.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            if tree.where("moved").isEmpty():
                break
            tree = tree.drop("moved")
        tree = tree.select("node", "up")
        levels.append(tree)
        a = tree.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        b = tree.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = cut(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = levels[0].select("node", F.col("up").alias("root"))
    for level in levels[1:]:
        step = level.select(F.col("node").alias("root"), "up")
        out = out.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out
