"""Result mappers: from statistics of runs to the measures of an evaluation. A run is (experiment, run)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.expressions import capped_share
from tracelab.operators.quantiles import quantiles

RUN = ("experiment", "run")
#: Start of the measured time, and the end of a run, in ms.
WARM, CUT = 86_400_000, 129_600_000
TIMES = ("Time", "SubmissionTime", "SimulationTime")


def time_column(df: DataFrame) -> str:
    return next(c for c in TIMES if c in df.columns)


def after(df: DataFrame, t: int = WARM) -> DataFrame:
    return df.where(F.col(time_column(df)) >= t)


def before(df: DataFrame, t: int = CUT) -> DataFrame:
    return df.where(F.col(time_column(df)) < t)


def last_measurement(df: DataFrame, per_run: bool = True, keys: Sequence[str] = RUN) -> DataFrame:
    """Rows at the largest Time of their run or, as one reading has it, of all rows."""
    if per_run:
        latest = df.groupBy(*keys).agg(F.max("Time").alias("Time"))
        return df.join(latest, [*keys, "Time"], "left_semi")
    return df.join(F.broadcast(df.agg(F.max("Time").alias("Time"))), "Time", "left_semi")  # one row


def drop_withdrawn(df: DataFrame) -> DataFrame:
    return df.where(F.col("JobStatus") != "W")


def only_fully_started(df: DataFrame) -> DataFrame:
    return df.where(F.col("TotalTasks") == F.col("TasksStarted"))


def inc_job_count(df: DataFrame) -> DataFrame:
    """CountJobsWithInp from other counters where the statistics have none."""
    if "CountJobsWithInp" in df.columns:
        return df
    waiting = F.col("CountJobs") - F.col("TotalJobsFullyScheduled") - F.col("PendingJobsFullyScheduled")
    return df.withColumn("CountJobsWithInp", F.col("TimesServerFlavorTaken") + F.col("TimesSwitchFlavorTaken") + F.col("TimesServerFallbackResubmit") + waiting)


def success_ratios(df: DataFrame) -> DataFrame:
    """Success of jobs and of in-network flavors in percent; null where nothing was possible."""
    df = df.withColumn("EffectiveCountJobs", F.col("CountJobs") - F.col("TimesServerFallbackResubmit"))
    with_inc = F.col("CountJobsWithInp") + 1
    return df.withColumns(
        {
            "AllocatedIncSuccess": capped_share(F.col("TotalJobsFullyScheduledINP"), with_inc),
            "RollingIncTaken": capped_share(F.col("TimesSwitchFlavorTaken"), with_inc),
            "WastedAllocations": capped_share(F.col("CountPreemptions"), F.col("ScheduledTasks") + F.col("CountPreemptions")),
            "SchedulingSuccess": capped_share(F.col("TotalJobsFullyScheduled") + F.col("PendingJobsFullyScheduled"), F.col("EffectiveCountJobs")),
        }
    )


def sim_speed(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Simulated against wall time in percent, capped at 100, over the whole run and since the row before; 0 without wall time."""
    w = Window.partitionBy(*keys).orderBy("Time")
    speed = lambda time, wall: F.when(wall > 0, time / 1000 / wall * 100).otherwise(0.0)
    wall, time = (F.col(c) - F.lag(c).over(w) for c in ("PastSystemMs", "Time"))
    return df.withColumn("SimSpeed", speed(F.col("Time"), F.col("PastSystemMs"))).withColumn("SimSpeedRolling", F.least(F.lit(100.0), speed(time, F.coalesce(wall, F.lit(0))))).withColumn("SimSpeedCapped", F.least("SimSpeed", F.lit(100.0)))


def rolling_share(df: DataFrame, col: str, keys: Sequence[str] = RUN) -> DataFrame:
    """Growth since the row before, in percent of the run's largest."""
    w = Window.partitionBy(*keys)
    grown = df.withColumn("_step", F.coalesce(F.col(col) - F.lag(col).over(w.orderBy("Time")), F.lit(0)))
    return grown.withColumn(f"{col}Rolling", capped_share(F.col("_step"), F.max("_step").over(w))).drop("_step")


def solver_times(df: DataFrame) -> DataFrame:
    ns = F.col("EndTimeNanos") - F.col("StartTimeNanos")
    return df.withColumns({"ElapsedNanos": ns, "ElapsedMs": ns / 1_000_000, "Nodes": F.col("ProducerCnt") + F.col("NonProducerCnt")})


@dataclass(frozen=True)
class Summary:
    """A column to summarise, for each value of some columns, over some rows."""

    col: str
    by: tuple[str, ...] = ()
    where: Column | None = None


def five_number(df: DataFrame, specs: Sequence[Summary], keys: Sequence[str] = RUN) -> DataFrame:
    """Mean, median, p25, p95 and p99 for each run; summaries that share their by-columns come from the same passes, others are merged."""
    ps = {"median": 0.5, "p25": 0.25, "p95": 0.95, "p99": 0.99}
    frames = []
    for by in dict.fromkeys(s.by for s in specs):
        values = {s.col: F.col(s.col) if s.where is None else F.when(s.where, F.col(s.col)) for s in specs if s.by == by}
        on = [*keys, *by]
        found = df.groupBy(*on).agg(*[F.avg(x).alias(f"{c}_mean") for c, x in values.items()]).join(quantiles(df, on, values, ps), on, "left")
        frames.append(found.select(*on, *[f"{c}_{n}" for c in values for n in ("mean", *ps)]))
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], "full_outer"), frames)


def inc_tg_success(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """For runs of the hire family: task groups with a flavor, those allocated in-network, and their share in percent."""
    if "FlavorInp" not in df.columns:
        df = df.withColumn("FlavorInp", F.when(F.col("TaskGroupType") == "S", "N").otherwise("Y"))
    if "ValidForJob" not in df.columns:
        df = df.withColumn("ValidForJob", F.when(F.col("JobStatus") == "W", "N").otherwise("Y"))
    has, got = F.col("FlavorInp").isin("Y", "N"), (F.col("FlavorInp") == "Y") & (F.col("ValidForJob") == "Y") & (F.col("JobStatus") != "W")
    out = df.where(F.col("scheduler-strategy") == "hire").groupBy(*keys).agg(F.count_if(has).alias("TaskGroupsWithFlavor"), F.count_if(got).alias("TaskGroupsIncAllocated"))
    return out.withColumn("AllocatedIncSuccess", capped_share(F.col("TaskGroupsIncAllocated"), F.col("TaskGroupsWithFlavor")))


def placement_latency(df: DataFrame, cut: int = CUT, patience: int = 1000) -> DataFrame:
    """Latency from submission to the last start; for groups not fully started the time until the cut, or `patience` if they came that shortly before it."""
    valid = F.col("ValidForJob") == "Y" if "ValidForJob" in df.columns else (F.col("JobStatus") != "N") | (F.col("TaskGroupType") != "I")
    df = df.where(valid).withColumn("TasksNotStarted", F.col("TotalTasks") - F.col("TasksStarted"))
    late = F.when(F.col("SubmissionTime") < cut - patience, F.lit(cut) - F.col("SubmissionTime")).otherwise(F.lit(patience))
    latency = F.when(F.col("TasksNotStarted") == 0, F.col("PlacementLatency") - F.col("SubmissionTime")).when(F.col("TasksNotStarted") > 0, late).otherwise(F.col("PlacementLatency"))
    df = df.withColumn("PlacementLatency", latency).withColumn("CompletionTime", F.col("PlacementLatency") + F.col("Duration"))
    return df.withColumns({"CompletionTimeS": F.col("CompletionTime") / 1000, "CompletionTimeM": F.col("CompletionTime") / 60_000})


def property_ids(df: DataFrame) -> list[int]:
    return sorted({int(m[1]) for c in df.columns if (m := re.fullmatch(r"TotalSwitch_Prop(\d+)_Dim\d+", c))})


def inc_load_summary(df: DataFrame, ids: Sequence[int] | None = None, dims: int = 3) -> DataFrame:
    """Of each property: its share of active switches, its load in each dimension (used and blocked) and their mean; of each dimension, what is unused over all properties."""
    ids = [p for p in (property_ids(df) if ids is None else ids) if f"TotalSwitch_Prop{p}_Dim0" in df.columns]
    at = lambda kind, p, d: F.col(f"{kind}Switch_Prop{p}_Dim{d}")
    add = lambda cols: reduce(lambda a, b: a + b, cols, F.lit(0.0))
    load = {(p, d): at("Utilization", p, d) + at("BlockedByOthers", p, d) for p in ids for d in range(dims)}
    out: dict[str, Column] = {f"Prop{p}_Dim{d}_Load": x for (p, d), x in load.items()}
    for p in ids:
        out[f"Prop{p}_Load"] = add(load[p, d] for d in range(dims)) / dims
        out[f"Prop{p}_Active"] = F.when(F.greatest(*[at("Total", p, d) for d in range(dims)]) > 0, 1.0).otherwise(0.0) if dims > 1 else F.when(at("Total", p, 0) > 0, 1.0).otherwise(0.0)
    for d in range(dims):
        total = add(at("Total", p, d) for p in ids)
        out[f"Total_Dim{d}"] = total
        out[f"Unused_Dim{d}"] = add((1 - load[p, d]) * at("Total", p, d) for p in ids) / (total + 0.01)
    return df.withColumns(out)


def resource_usage(inc: DataFrame, cell: DataFrame, sweeps: Sequence[str] = (), keys: Sequence[str] = RUN, dims: int = 3, server_dims: int = 2) -> DataFrame:
    """Load of switch and server dimensions in percent and the fullest of each, where both tables have a row."""
    on = [*sweeps, "Time", *keys, *(c for c in ("scheduler", "scheduler-strategy") if c in inc.columns and c in cell.columns)]
    both = inc.select(*on, *[f"Unused_Dim{d}" for d in range(dims)]).join(cell.select(*on, *[f"UtilizationServersDim{d}" for d in range(server_dims)]), on)
    switch = {f"SwitchDim{d}": (1 - F.col(f"Unused_Dim{d}")) * 100 for d in range(dims)}
    server = {f"ServerDim{d}": F.col(f"UtilizationServersDim{d}") * 100 for d in range(server_dims)}
    return both.select(*on, *[x.alias(n) for n, x in (switch | server).items()], F.greatest(*switch.values()).alias("SwitchBottleneck"), F.greatest(*server.values()).alias("ServerBottleneck"))


def tg_vs_job_success(tg: DataFrame, sched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Success of task groups beside that of jobs at the last measurement of a run, how complete the former is, and what both lack."""
    jobs = last_measurement(sched, keys=keys).select(*keys, F.col("AllocatedIncSuccess").alias("JobIncSuccess"))
    both = tg.select(*keys, F.col("AllocatedIncSuccess").alias("TgIncSuccess")).join(jobs, list(keys))
    return both.withColumns({"Completeness": capped_share(F.col("JobIncSuccess"), F.col("TgIncSuccess")), "TgNotAllocated": 100 - F.col("TgIncSuccess"), "JobNotAllocated": 100 - F.col("JobIncSuccess")})


def describe_by(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    facts = df.groupBy(*keys).agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    found = quantiles(df, keys, {"q": F.col(col)}, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return facts.join(found, list(keys), "left").select(*keys, "count", "mean", "std", "min", *[F.col(f"q_{p}").alias(p) for p in ("p25", "p50", "p75")], "max")
