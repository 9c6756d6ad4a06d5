"""Exact quantiles by narrowing ranges, sketches, and bootstrap bands, against plain computation."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators import figures, histogram, mappers, quantiles


def values():
    draw = random.Random(4)
    rows = [("hot", draw.lognormvariate(0, 6)) for _ in range(3000)] + [("ties", float(draw.randrange(4))) for _ in range(700)]
    rows += [("one", 7.5), ("pair", -1e300), ("pair", 1e300), ("none", None), ("nan", float("nan")), ("nan", 2.0), ("same", 3.0), ("same", 3.0), ("same", None)]
    rows += [("spike", 1.0)] * 500 + [("spike", 1.0 + k * 2.0**-52) for k in range(40)] + [("spike", 1e18)]
    return rows


@pytest.mark.parametrize(("few", "cells"), [(50_000, 1024), (5, 4), (1, 1000)])
def test_quantiles_by_narrowing(spark, few, cells):
    """However few rows are ranked at once, and whatever the cells."""
    df = spark.createDataFrame(values(), "g string, x double").repartition(4)
    ps = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], {"a": F.col("x"), "b": F.when(F.col("x") > 1, -F.col("x"))}, ps, few, cells).collect()}
    groups = defaultdict(list)
    for g, x in values():
        if x is not None and x == x:
            groups[g].append(x)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, own in (("a", xs), ("b", [-x for x in xs if x > 1])):
            for p, q in ps.items():
                found = got[g][f"{name}_{p}"]
                assert found is None if not own else found == pytest.approx(float(np.quantile(np.array(own), q)), rel=1e-12, abs=1e-290), (g, name, p)


def test_order_statistics_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x"))
    got = quantiles.order_statistics(df, [], "x", F.array(F.lit(0).cast("bigint"), F.lit(999).cast("bigint"), F.lit(5000).cast("bigint"), (F.col("n") / 2).cast("bigint")), few=3, cells=10)
    assert {(r.rank, r.x) for r in got.collect()} == {(0, 0.0), (999, 999.0), (500, 500.0)}
    assert quantiles.order_statistics(df.limit(0), [], "x", F.array(F.lit(0).cast("bigint"))).count() == 0


def test_sketches_merge(spark):
    df = spark.createDataFrame([(k % 2, k % 5, float(k)) for k in range(20_000)], "g int, run int, x double")
    whole = quantiles.sketches(df, ["g", "run"], "x").groupBy("g").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    for r in quantiles.sketched_quantiles(whole, {"p50": 0.5, "p99": 0.99}).collect():
        assert abs(r.p50 - 10_000) < 60 and abs(r.p99 - 19_800) < 60


def test_tail_report_by_sketch(spark):
    df = spark.createDataFrame([(0, float(k), k) for k in range(5000)], "g int, x double, SubmissionTime long")
    exact, near = (histogram.tail_report(df, "x", ["g"], approx=a).first() for a in (False, True))
    assert exact["p99"] == pytest.approx(4949.01) and exact["tail_count"] == 50 and abs(near["p99"] - exact["p99"]) < 20 and near["count"] == 5000


def test_describe_of_an_empty_column(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 4.0)], "g string, x double")
    got = {r.g: r for r in mappers.describe_by(df, ["g"], "x").collect()}
    assert got["a"]["count"] == 0 and got["a"].p50 is None and (got["b"].p25, got["b"].p50) == (2.5, 3.0)


def test_bootstrap_bands(spark):
    """Bands cover the mean, shrink with the rows, don't depend on partitions, and are near the normal ones."""
    draw = random.Random(8)
    rows = [("small", k, draw.gauss(10, 2)) for k in range(50)] + [("large", k, draw.gauss(10, 2)) for k in range(5000)] + [("one", 0, 3.0), ("null", 0, None)]
    df = spark.createDataFrame(rows, "g string, k int, y double")
    one, two = ({r.g: (r.mean, r.low, r.high) for r in figures.mean_band(df.repartition(n), ["g"], "y", ["g", "k"], n_boot=400).collect()} for n in (1, 7))
    assert set(one) == {"small", "large", "one"}
    normal = {r.g: (r.mean, r.low, r.high) for r in figures.mean_band(df, ["g"], "y", ["g", "k"], method="normal").collect()}
    for g in one:
        assert one[g] == pytest.approx(two[g])
    for g in ("small", "large"):
        mean, low, high = one[g]
        assert low < mean < high and (high - low) == pytest.approx(normal[g][2] - normal[g][1], rel=0.25)
    assert one["one"] == pytest.approx((3.0, 3.0, 3.0))


def test_bootstrap_flushes_groups(spark, monkeypatch):
    df = spark.createDataFrame([(k, j, float(j)) for k in range(5000) for j in range(2)], "g int, k int, y double").coalesce(1)
    band = figures.mean_band(df, ["g"], "y", ["g", "k"], n_boot=20)
    assert band.count() == 5000 and band.where("low < 0 or high > 1").count() == 0
