"""Histograms and distribution functions. A value's bin is computed, never searched for; ends are pinned to the data's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelab.operators.quantiles import order_statistics, quantiles, sketched_quantiles, sketches


def _dense(counts: DataFrame, groups: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """All bins of all groups (which carry low and high), with their counts."""
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def auto_histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int, log: bool = False) -> DataFrame:
    """`bins` slots of each group from its least to its largest value; a value counts in the last slot that begins at or below it.

    Columns keys, bin, edge, n. With log, slots are even in log10 from the floor of the least positive value's; values up
    to 0 count in slot 0. A group of a single value has no histogram.
    """
    x = F.col(value).cast("double")
    low = F.min(F.when(x > 0, x)) if log else F.min(x)
    spans = df.where(x.isNotNull()).groupBy(*keys).agg(low.alias("low"), F.max(x).alias("high"), F.min(x).alias("least")).where("least < high and low is not null")
    if log:
        spans = spans.withColumn("low", F.floor(F.log10("low")).cast("double")).withColumn("high", F.log10("high"))
    spans = spans.withColumn("step", (F.col("high") - F.col("low")) / (bins - 1)).select(*keys, "low", "step")
    at = F.when(x > 0, F.log10(x)) if log else x
    cell = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(at - F.col("low"), F.col("step")) + 1e-9), F.lit(0)))).cast("int")
    counts = df.where(x.isNotNull()).join(spans, list(keys)).groupBy(*keys, cell.alias("bin")).agg(F.count("*").alias("n"))
    edge = F.col("low") + F.col("bin") * F.col("step")
    return _dense(counts, spans, keys, bins).select(*keys, "bin", (F.pow(F.lit(10.0), edge) if log else edge).alias("edge"), "n")


def unit_histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int) -> DataFrame:
    """Counts of values in [0, 1] in even slots, 1 in the last."""
    cell = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(0, 1)).groupBy(*keys, cell.alias("bin")).agg(F.count("*").alias("n"))
    return _dense(counts, df.select(*keys).distinct(), keys, bins).select(*keys, "bin", (F.col("bin") / bins).alias("edge"), "n")


def log_cdf(df: DataFrame, value: str, run_keys: Sequence[str], config: Sequence[str], n: int = 100) -> DataFrame:
    """Distribution function of each run over n edges, even in log10, that all runs of one configuration share.

    Columns config, run_keys, bin, edge (left), cdf (share up to and including the bin), ccdf. The edges run from the least
    positive to the largest value, whatever the order of runs; values up to 0 are in bin 0.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*config, *run_keys, x.alias("x"))
    spans = rows.groupBy(*config).agg(F.min(F.when(F.col("x") > 0, F.log10("x"))).alias("low"), F.max(F.when(F.col("x") > 0, F.log10("x"))).alias("high")).where("low is not null")
    bins = n - 1
    cell = F.coalesce(F.floor(F.try_divide(F.log10("x") - F.col("low"), F.col("high") - F.col("low")) * bins + 1e-9), F.lit(0))
    cell = F.when(F.col("x") <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), cell))).cast("int")
    keys = [*config, *run_keys]
    counts = (rows.join(spans, list(config)) if config else rows.crossJoin(F.broadcast(spans))).groupBy(*keys, cell.alias("bin")).agg(F.count("*").alias("n"))
    runs = rows.select(*keys).distinct()
    runs = runs.join(spans, list(config)) if config else runs.crossJoin(F.broadcast(spans))
    w = Window.partitionBy(*keys)
    dense = _dense(counts, runs, keys, bins)
    cdf = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    edge = F.pow(F.lit(10.0), F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins)
    return dense.select(*keys, "bin", edge.alias("edge"), cdf.alias("cdf")).withColumn("ccdf", 1 - F.col("cdf"))


def tail_report(df: DataFrame, value: str, keys: Sequence[str], time: str = "SubmissionTime", approx: bool = False) -> DataFrame:
    """Percentiles 75, 90, 95 and 99 of a value, and count, mean, least and largest time of the rows above the 99th. approx: by sketches, in one pass."""
    ps = {f"p{p}": p / 100 for p in (75, 90, 95, 99)}
    if approx:
        tops = sketched_quantiles(sketches(df, keys, value), ps)
    else:
        found = quantiles(df, keys, {"q": F.col(value)}, ps)
        tops = found.select(*keys, *[F.col(f"q_{p}").alias(p) for p in ps])
    tops = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean")).join(tops, list(keys), "left").select(*keys, *ps, "count", "mean")
    above = df.select(*keys, value, time).join(tops.select(*keys, "p99"), list(keys)).where(F.col(value) > F.col("p99"))
    tail = above.groupBy(*keys).agg(F.count("*").alias("tail_count"), F.avg(time).alias("tail_mean_time"), F.min(time).alias("tail_first_time"), F.max(time).alias("tail_last_time"))
    return tops.join(tail, list(keys), "left").withColumn("tail_count", F.coalesce("tail_count", F.lit(0)))


def upper_median_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Least, mean (integer division), upper median (element n/2 from 0) and largest value."""
    kind = dict(df.dtypes)[value]
    x = df.where(F.col(value).isNotNull())
    middle = order_statistics(x.select(*keys, value), keys, value, F.array(F.floor(F.col("n") / 2).cast("bigint"))).select(*keys, F.col("x").cast(kind).alias("median"))
    facts = x.groupBy(*keys).agg(F.min(value).alias("min"), F.expr(f"sum(`{value}`) div count(1)").alias("mean"), F.max(value).alias("max"))
    return facts.join(middle, list(keys)).select(*keys, "min", "mean", "median", "max")
