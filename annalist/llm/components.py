"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import forget, stored


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")  # so that a hub's rows can be split
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stored(down.groupBy("a").agg(F.min("b").alias("m")), "low")
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))), low


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (a, b: long); root is the smallest node that it reaches.

    Every step is a grouping, whose minima are written, and a plain join with them, which Spark splits where a hub has too many
    rows. The driver sees two numbers a round, and the tables of a round are deleted after the next. Rounds grow with the
    logarithm of the longest path. Loops and repeated links do no harm; an empty table gives an empty result.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        large, low = _large_star(edges)
        small, lower = _small_star(large.filter("a <> b").distinct())
        nxt = stored(small.filter("a <> b").distinct(), "links")
        new = _mark(nxt)
        forget(edges, low, lower)
        edges = nxt
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.distinct())
