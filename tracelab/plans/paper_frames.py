"""The six tables behind the usual figures, from loaded statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators import figures, histogram, mappers


def inc_success(sched: DataFrame, x: str = "mu") -> DataFrame:
    """Mean and normal band of in-network success and preemptions at the end of runs, by x and scheduler, in percent of x."""
    last = mappers.last_measurement(mappers.success_ratios(mappers.inc_job_count(sched)))
    long = figures.melt(last.withColumn("CountPreemptions", F.col("CountPreemptions").cast("double")), ["experiment", "run", "scheduler", x], ["AllocatedIncSuccess", "CountPreemptions"])
    return figures.scale_percent(figures.mean_band(long, ["scheduler", x, "origin_column"], "y", ["experiment", "run"], method="normal"), x)


def tg_not_allocated(tgs: DataFrame, sched: DataFrame, x: str = "mu") -> DataFrame:
    """What share of in-network groups and jobs isn't allocated, by x."""
    groups = mappers.inc_tg_success(tgs)
    where = sched.select("experiment", "run", x).distinct()
    both = mappers.tg_vs_job_success(groups, mappers.success_ratios(sched)).join(where, ["experiment", "run"])
    return both.groupBy(x).agg(F.avg("TgNotAllocated").alias("TgNotAllocated"), F.avg("JobNotAllocated").alias("JobNotAllocated"))


def latency_tail(tgs: DataFrame, n: int = 100) -> DataFrame:
    return histogram.log_cdf(mappers.placement_latency(mappers.drop_withdrawn(tgs)), "PlacementLatency", ["scheduler"], [], n)


def locality(tgs: DataFrame, x: str = "mu") -> DataFrame:
    """Detours and racks of fully started in-network groups, by x and scheduler."""
    rows = mappers.only_fully_started(mappers.drop_withdrawn(tgs)).where("TaskGroupType = 'I'")
    return mappers.describe_by(rows, ["scheduler", x], "InvolvedRacks")


def load_by_dim(inc: DataFrame, cell: DataFrame, dims: int = 3, server_dims: int = 2) -> DataFrame:
    """Distribution of load of each switch and server dimension over time."""
    use = mappers.resource_usage(mappers.inc_load_summary(inc, dims=dims), cell, dims=dims, server_dims=server_dims)
    cols = [c for c in use.columns if c.startswith(("SwitchDim", "ServerDim"))]
    return mappers.describe_by(figures.melt(use, ["experiment", "run"], cols), ["origin_column"], "y")


def solver_cdf(solver: DataFrame, x: str = "mu", n: int = 100) -> DataFrame:
    return histogram.log_cdf(mappers.solver_times(solver), "ElapsedMs", [x], [], n)
