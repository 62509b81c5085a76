"""Connected components by alternating stars: each round is a few joins, and rounds grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.llm.common import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """vertex and root for each vertex that has an edge: root is the least vertex of its component.

    edges has long columns a and b; loops and repeated edges do no harm. The rounds end when a round changes nothing,
    seen from the number of edges and a sum over their hashes.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct()
        before = mark
        old, now = now, stored(_small_star(_large_star(now)), name)
        drop_stored(old)
