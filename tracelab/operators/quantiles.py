"""Quantiles of many groups at once, of which none is gathered in one task.

A quantile is one or two order statistics. For each, ever narrower ranges of values are counted in cells, which sums before it shuffles; once a range holds few
rows, those alone are ranked. Sketches that can be merged give approximate quantiles in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.sources.scratch import materialize

#: Rows of a range that are ranked in one task; cells of a round.
FEW, CELLS = 50_000, 1024


def order_statistics(rows: DataFrame, keys: Sequence[str], x: str, ranks: Column, few: int = FEW, cells: int = CELLS) -> DataFrame:
    """(keys, rank, n, x): the values of the given ranks, from 0, of each group. ranks: an array of bigints over the group's number of values, `n`. Nulls and NaN don't count; x is a double."""
    names = list(keys)
    keys = [f"_key{i}" for i in range(len(names))]  # whatever the caller's are called
    rows = rows.select(*[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)], F.col(x).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # A range (lo, hi) holds m values, of which the wanted one has rank r; groups with the same ranks share ranges.
    open_ = facts.withColumn("rank", F.explode(F.array_distinct(ranks))).where("rank >= 0 and rank < n").select(*keys, "rank", "n", "lo", "hi", F.col("rank").alias("r"), F.col("n").alias("m"))
    open_ = materialize(open_, "ranks")
    ready = open_.where((F.col("m") <= few) | (F.col("lo") == F.col("hi")))
    open_ = open_.where((F.col("m") > few) & (F.col("lo") < F.col("hi")))
    while not open_.isEmpty():
        ranges = open_.groupBy(*keys, "lo", "hi").agg(F.count("*").alias("_"))
        inside = _inside(rows, ranges, keys)
        width = F.col("hi") - F.col("lo")
        cell = F.least(F.lit(cells - 1), F.floor((F.col("x") - F.col("lo")) / width * cells)).cast("int")
        counts = inside.groupBy(*keys, "lo", "hi", cell.alias("c")).agg(F.count("*").alias("k"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.sum("k").over(Window.partitionBy(*keys, "lo", "hi").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
        met = open_.join(counts.withColumn("before", before), [*keys, "lo", "hi"]).where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("k")))
        next_ = materialize(met.select(*keys, "rank", "n", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("r") - F.col("before")).alias("r"), F.col("k").alias("m")), "ranks")
        ready = ready.unionByName(next_.where((F.col("m") <= few) | (F.col("lo") == F.col("hi"))))
        open_ = next_.where((F.col("m") > few) & (F.col("lo") < F.col("hi")))
    done = ready.where("lo = hi").select(*keys, "rank", "n", F.col("lo").alias("x"))
    left = ready.where("lo < hi")
    inside = _inside(rows, left.select(*keys, "lo", "hi").distinct(), keys)
    ranked = inside.withColumn("r", (F.row_number().over(Window.partitionBy(*keys, "lo", "hi").orderBy("x")) - 1).cast("bigint"))
    found = done.unionByName(left.join(ranked, [*keys, "lo", "hi", "r"]).select(*keys, "rank", "n", "x"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(names, keys, strict=True)], "rank", "n", "x")


def _inside(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with each of their group's ranges (lo, hi) that they are in. A group has a few ranges, so it is met once and its rows are told which."""
    own = ranges.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    fit = F.explode(F.filter("_ranges", lambda g: (F.col("x") >= g["lo"]) & (F.col("x") <= g["hi"]))).alias("g")
    return (rows.join(own, list(keys)) if keys else rows.crossJoin(F.broadcast(own))).select(*keys, "x", fit).select(*keys, "x", "g.lo", "g.hi")  # without keys, there is one group


def quantiles(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column], ps: Mapping[str, float], few: int = FEW, cells: int = CELLS) -> DataFrame:
    """(keys, value_p for each value and p): quantiles between neighbouring values, by how far the rank lies between them. All values are found in the same passes."""
    names = list(keys)
    keys = [f"_of{i}" for i in range(len(names))]
    long = rows.select(*[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)], F.inline(F.array(*[F.struct(F.lit(v).alias("_v"), c.cast("double").alias("x")) for v, c in values.items()])))
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array(*[f(at(p)).cast("bigint") for p in ps.values() for f in (F.floor, F.ceil)])
    found = order_statistics(long, [*keys, "_v"], "x", ranks, few, cells)
    each = []
    for v in values:
        for name, p in ps.items():
            side = lambda f, v=v, p=p: F.max(F.when((F.col("_v") == v) & (F.col("rank") == f(at(p)).cast("bigint")), F.col("x")))
            share = F.max(F.when(F.col("_v") == v, at(p) - F.floor(at(p))))
            each.append((side(F.floor) * (1 - share) + side(F.ceil) * share).alias(f"{v}_{name}"))
    return found.groupBy(*keys).agg(*each).withColumnsRenamed(dict(zip(keys, names, strict=True)))


def sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = 4096) -> DataFrame:
    """(keys, sketch): KLL sketches, which kll_merge can combine over files, runs or days; their rank error is about 1/k."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketched_quantiles(found: DataFrame, ps: Mapping[str, float]) -> DataFrame:
    """Columns for the quantiles of a sketch, in place of it; values of the data, not between them."""
    return found.select(*[c for c in found.columns if c != "sketch"], *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in ps.items()])
