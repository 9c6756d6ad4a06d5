"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import SHORT, attach, stage


def _told(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows with what least says of their a. Beyond SHORT edges, a node with a large share of them is no hot key."""
    return attach(rows, least, "a", "n", total) if total > SHORT else rows.join(least, "a")


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Hooks neighbours to the smallest node around: larger neighbours in a large star, the others in a small one."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        out = _told(around.where("b > a"), least, 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = _told(edges, least, total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns a, b: the smallest node b that each node a of the edges is connected with, but for those nodes themselves.

    Edges are pairs (a, b) of longs, repeated or in either direction; loops say nothing. No edges give no rows.
    Each round is staged; there are about log(n) of them.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen, total = None, now.count()
    while total:
        now = stage(_star(_star(now, total, large=True), total, large=False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, total = mark, mark[0]
    return now
