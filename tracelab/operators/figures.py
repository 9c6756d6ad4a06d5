"""Frames that figures are drawn from."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.functions.expressions import hash_unit
from tracelab.operators.quantiles import quantiles


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(cols), "origin_column", "y")


#: Two-sided normal quantiles of the usual confidence levels.
Z = {95: 1.959963984540054, 99: 2.5758293035489004}


def mean_band(df: DataFrame, keys: Sequence[str], y: str, row_key: Sequence[str], ci: int = 95, n_boot: int = 1000, seed: int = 0, method: str = "bootstrap") -> DataFrame:
    """(keys, mean, low, high): the mean with its confidence band.

    bootstrap: each row gets a Poisson(1) weight in each replicate, by hash of its key; a task holds the sums of all replicates of its
    groups, so that rows aren't copied and two arrays a group and task are shuffled. normal: mean and standard error, without replicates.
    """
    rows = df.where(F.col(y).isNotNull())
    base = rows.groupBy(*keys).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("_s"), F.count("*").alias("_n"))
    if method == "normal":
        half = F.coalesce(F.col("_s") / F.sqrt("_n") * Z[ci], F.lit(0.0))
        return base.select(*keys, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
    sums = rows.select(*keys, F.col(y).cast("double").alias("_y"), F.xxhash64(F.lit(seed), *[F.col(c) for c in row_key]).alias("_h"))
    parts = sums.mapInArrow(_replicate_sums(list(keys), n_boot), ", ".join([f"`{c}` {t}" for c, t in sums.select(*keys).dtypes] + ["_w array<double>", "_wy array<double>"]))
    # A row for each group and task; replicates are added up place by place.
    each = parts.select(*keys, F.posexplode(F.arrays_zip("_w", "_wy")).alias("_b", "_x")).groupBy(*keys, "_b").agg(F.try_divide(F.sum("_x._wy"), F.sum("_x._w")).alias("_m"))
    edge = (100 - ci) / 200
    band = each.groupBy(*keys).agg(F.percentile("_m", F.lit(edge)).alias("low"), F.percentile("_m", F.lit(1 - edge)).alias("high"))  # n_boot values a group
    return base.join(band, list(keys)).select(*keys, "mean", "low", "high")


#: Groups whose sums a task holds at once.
HELD = 2048


def _replicate_sums(keys: list[str], n_boot: int):
    """Of each group the sums of weights and of weighted values by replicate, over rows of a task; a group may come more than once. Weights are Poisson(1) by hash of row and replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)])  # more than 7 has a chance of 1e-5
        salts = np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums: dict[tuple, np.ndarray] = {}

        def out(schema: pa.Schema) -> pa.RecordBatch:
            own = [pa.array([k[c] for k in sums], schema.field(c).type) for c in range(len(keys))]
            both = [pa.array([v[side].tolist() for v in sums.values()], pa.list_(pa.float64())) for side in (0, 1)]
            sums.clear()
            return pa.RecordBatch.from_arrays([*own, *both], [*keys, "_w", "_wy"])

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            names = {k: i for i, k in enumerate(dict.fromkeys(rows))}
            group = np.fromiter((names[k] for k in rows), np.int64, len(rows))
            y, h = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy().view(np.uint64)
            order = np.argsort(group, kind="stable")
            for k, at in zip(names, np.split(order, np.cumsum(np.bincount(group))[:-1]), strict=True):
                held = sums.setdefault(k, np.zeros((2, n_boot)))
                for some in np.array_split(at, -(-len(at) // 512)):
                    weight = np.searchsorted(steps, _units(h[some, None] ^ salts), "right").astype(np.float64)
                    held[0] += weight.sum(0)
                    held[1] += y[some] @ weight
                if len(sums) >= HELD:
                    yield out(batch.schema)
            last = batch.schema
        if sums:
            yield out(last)

    return run


def _units(h: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from mixed hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def violin_stats(df: DataFrame, keys: Sequence[str], y: str, grid: int = 100, bins: int = 1000) -> DataFrame:
    """(keys, p25, p50, p75, at, density): quartiles, and a Gaussian kernel density between the least and largest value, by Scott's rule.

    Values are counted in fine bins first, so the kernel's cost doesn't grow with rows.
    """
    x = df.where(F.col(y).isNotNull())
    quartiles = quantiles(x, keys, {"q": F.col(y)}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumnsRenamed({f"q_{p}": p for p in ("p25", "p50", "p75")})
    facts = x.groupBy(*keys).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.count("*").alias("_n"), F.stddev_samp(y).alias("_s")).where("_hi > _lo").join(quartiles, list(keys))
    width = (F.col("_hi") - F.col("_lo")) / bins
    cell = F.least(F.lit(bins - 1), F.floor((F.col(y) - F.col("_lo")) / width)).cast("int")
    counts = x.join(facts.select(*keys, "_lo", "_hi"), list(keys)).groupBy(*keys, cell.alias("_c")).agg(F.count("*").alias("_k"))
    points = facts.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("at", F.col("_lo") + F.col("_g") * (F.col("_hi") - F.col("_lo")) / (grid - 1))
    band = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    z = (F.col("at") - F.col("_lo") - (F.col("_c") + 0.5) * width) / band
    summed = points.join(counts, list(keys)).groupBy(*keys, "p25", "p50", "p75", "at").agg((F.sum(F.col("_k") * F.exp(-z * z / 2)) / F.max(F.col("_n") * band) / 2.5066282746310002).alias("density"))
    return summed


def label_series(df: DataFrame, col: str, names: Mapping[str, str]) -> DataFrame:
    """df with label and order by a table of known names; unknown ones keep their name, come last and are marked."""
    dim = df.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(names.items())], f"`{col}` string, label string, `order` int")
    out = df.join(F.broadcast(dim), col, "left")  # the caller's names
    return out.withColumn("known", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", col)).withColumn("order", F.coalesce("order", F.lit(len(names))))


def scale_percent(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col) * 100)
