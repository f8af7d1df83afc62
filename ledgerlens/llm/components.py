"""Connected components of a link table by alternating stars.

Every round links a node's larger neighbours to its smallest one, then its smaller ones, until
nothing changes; rounds grow with the logarithm of the longest path.  All work is joins and
aggregates over links; rounds are staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import staged


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """Columns a, b (whole numbers) to (node, label): the smallest node that can be reached."""
    tidy = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(tidy, "links")
    previous = None
    while True:
        both = edges.selectExpr("a u", "b v").unionByName(edges.selectExpr("b u", "a v"))
        large = both.join(_smallest(both), "u").filter("v > u").selectExpr("v a", "m b").distinct()
        down = large.selectExpr("a u", "b v")
        joined = down.join(_smallest(down), "u")
        small = joined.selectExpr("v a", "m b").unionByName(joined.selectExpr("u a", "m b")).filter("a <> b").distinct()
        edges = staged(small, "links")
        # all links point at roots once no node has two targets and no target points on; sums tell a change
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint")), F.countDistinct("a")).first()
        if state == previous:
            return edges.selectExpr("a node", "b label")
        previous = state
