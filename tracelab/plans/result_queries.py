"""Queries: result mappers, histograms and distribution functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.expressions import scheduler_family
from tracelab.operators import histogram, mappers
from tracelab.plans.registry import query, rounded
from tracelab.plans.views import view

TG = "select experiment, run, JobID, TaskGroupID, SubmissionTime"


@query("select experiment, run, Time, CountJobs from counters where Time >= 3600000", "counters")
def e1_after(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.after(view(spark, sf, "counters"), 3_600_000).select("experiment", "run", "Time", "CountJobs")


@query("select experiment, run, TaskGroupID, SubmissionTime from taskgroups where SubmissionTime < 80000000", "taskgroups")
def e2_before(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.before(view(spark, sf, "taskgroups"), 80_000_000).select("experiment", "run", "TaskGroupID", "SubmissionTime")


@query("select experiment, run, Time, CountJobs, CountPreemptions from counters qualify Time = max(Time) over (partition by experiment, run)", "counters")
def e3_last_measurement(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.last_measurement(view(spark, sf, "counters")).select("experiment", "run", "Time", "CountJobs", "CountPreemptions")


@query("select experiment, run, Time, CountJobs from counters where Time = (select max(Time) from counters)", "counters")
def e3_last_measurement_of_all(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.last_measurement(view(spark, sf, "counters"), per_run=False).select("experiment", "run", "Time", "CountJobs")


@query(f"{TG} from taskgroups where JobStatus <> 'W'", "taskgroups")
def e4_drop_withdrawn(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.drop_withdrawn(view(spark, sf, "taskgroups")).select("experiment", "run", "JobID", "TaskGroupID", "SubmissionTime")


@query(f"{TG} from taskgroups where TotalTasks = TasksStarted", "taskgroups")
def e5_only_fully_started(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.only_fully_started(view(spark, sf, "taskgroups")).select("experiment", "run", "JobID", "TaskGroupID", "SubmissionTime")


@query("select experiment, run, Time, Allocations, TimesServerFallbackResubmit + TimesSwitchFlavorTaken * 2 + CountJobs - TotalJobsFullyScheduled - PendingJobsFullyScheduled as CountJobsWithInp from counters", "counters")
def e6_inc_job_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "counters").drop("CountJobsWithInp").withColumn("TimesServerFlavorTaken", F.col("TimesSwitchFlavorTaken"))
    return mappers.inc_job_count(rows).select("experiment", "run", "Time", "Allocations", "CountJobsWithInp")


@query(
    """select experiment, run, Time, Allocations, CountJobs - TimesServerFallbackResubmit as EffectiveCountJobs, round(100.0 * TotalJobsFullyScheduledINP / (1 + CountJobsWithInp), 4) as AllocatedIncSuccess,
round(100.0 * TimesSwitchFlavorTaken / (1 + CountJobsWithInp), 4) as RollingIncTaken, round(100.0 * CountPreemptions / nullif(ScheduledTasks + CountPreemptions, 0), 4) as WastedAllocations,
round(100.0 * (TotalJobsFullyScheduled + PendingJobsFullyScheduled) / nullif(CountJobs - TimesServerFallbackResubmit, 0), 4) as SchedulingSuccess from counters""",
    "counters",
)
def e7_success_ratios(spark: SparkSession, sf: str) -> DataFrame:
    out = mappers.success_ratios(view(spark, sf, "counters"))
    return rounded(out.select("experiment", "run", "Time", "Allocations", "EffectiveCountJobs", "AllocatedIncSuccess", "RollingIncTaken", "WastedAllocations", "SchedulingSuccess"))


@query(
    """select experiment, run, Time, round(s, 4) as SimSpeed, round(least(s, 100), 4) as SimSpeedCapped, round(least(case when w > 0 then t / 1000 / w * 100 else 0 end, 100), 4) as SimSpeedRolling from (
select *, case when PastSystemMs > 0 then Time / 1000 / PastSystemMs * 100 else 0.0 end as s, PastSystemMs - lag(PastSystemMs) over x as w, Time - lag(Time) over x as t from counters window x as (partition by experiment, run order by Time))""",
    "counters",
)
def e8_sim_speed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mappers.sim_speed(view(spark, sf, "counters")).select("experiment", "run", "Time", "SimSpeed", "SimSpeedCapped", "SimSpeedRolling"))


@query(
    """with steps as (select *, coalesce(CountPreemptions - lag(CountPreemptions) over (partition by experiment, run order by Time), 0) as s from counters)
select experiment, run, Time, round(100.0 * s / nullif(max(s) over (partition by experiment, run), 0), 4) as CountPreemptionsRolling from steps""",
    "counters",
)
def e9_rolling_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mappers.rolling_share(view(spark, sf, "counters"), "CountPreemptions").select("experiment", "run", "Time", "CountPreemptionsRolling"))


@query("select experiment, run, SimulationTime, EndTimeNanos - StartTimeNanos as ElapsedNanos, round((EndTimeNanos - StartTimeNanos) / 1000000, 6) as ElapsedMs, ProducerCnt + NonProducerCnt as Nodes from solver", "solver")
def e10_solver_times(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mappers.solver_times(view(spark, sf, "solver")).select("experiment", "run", "SimulationTime", "ElapsedNanos", "ElapsedMs", "Nodes"), 6)


def _five(col: str, where: str = "true") -> str:
    q = ", ".join(f"round(quantile_cont({col}, {p}) filter (where {where}), 4) as {col}_{n}" for n, p in (("median", 0.5), ("p25", 0.25), ("p95", 0.95), ("p99", 0.99)))
    return f"round(avg({col}) filter (where {where}), 4) as {col}_mean, {q}"


@query(
    f"""with a as (select experiment, run, TaskGroupType, {_five("Duration", "TotalTasks > 2")} from taskgroups group by experiment, run, TaskGroupType), b as (select experiment, run, {_five("AvgQueueing")} from taskgroups group by experiment, run)
select * from a full join b using (experiment, run)""",
    "taskgroups",
)
def e11_five_number(spark: SparkSession, sf: str) -> DataFrame:
    specs = [mappers.Summary("Duration", ("TaskGroupType",), F.col("TotalTasks") > 2), mappers.Summary("AvgQueueing")]
    return rounded(mappers.five_number(view(spark, sf, "taskgroups"), specs))


INC = """select experiment, run, count(*) filter (where FlavorInp in ('Y', 'N')) as TaskGroupsWithFlavor, count(*) filter (where FlavorInp = 'Y' and ValidForJob = 'Y' and JobStatus <> 'W') as TaskGroupsIncAllocated,
round(100.0 * count(*) filter (where FlavorInp = 'Y' and ValidForJob = 'Y' and JobStatus <> 'W') / nullif(count(*) filter (where FlavorInp in ('Y', 'N')), 0), 4) as AllocatedIncSuccess from taskgroups where strategy = 'hire' group by experiment, run"""


@query(INC, "taskgroups")
def e12_inc_tg_success(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mappers.inc_tg_success(view(spark, sf, "taskgroups").withColumnRenamed("strategy", "scheduler-strategy")))


LATENCY = """latency as (select *, case when TotalTasks = TasksStarted then PlacementLatency - SubmissionTime when SubmissionTime < 129599000 then 129600000 - SubmissionTime else 1000 end as Latency from taskgroups where ValidForJob = 'Y')"""


@query(f"with {LATENCY} select experiment, run, TaskGroupID, Latency as PlacementLatency, Latency + Duration as CompletionTime, round((Latency + Duration) / 1000, 4) as CompletionTimeS from latency", "taskgroups")
def e13_placement_latency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mappers.placement_latency(view(spark, sf, "taskgroups")).select("experiment", "run", "TaskGroupID", "PlacementLatency", "CompletionTime", "CompletionTimeS"))


INC_VIEW = """wide as (select experiment, run, Time, (CountJobs % 10) / 20.0 as u1, (CountPreemptions % 7) / 20.0 as b1, cast(CountJobs % 13 as double) as t1, (Allocations % 8) / 20.0 as u2, (ScheduledTasks % 5) / 20.0 as b2, cast(ScheduledTasks % 3 as double) as t2 from counters)"""


def inc_wide(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "counters")
    at = {"UtilizationSwitch_Prop2_Dim0": F.col("CountJobs") % 10 / 20, "BlockedByOthersSwitch_Prop2_Dim0": F.col("CountPreemptions") % 7 / 20, "TotalSwitch_Prop2_Dim0": (F.col("CountJobs") % 13).cast("double")}
    at |= {"UtilizationSwitch_Prop5_Dim0": F.col("Allocations") % 8 / 20, "BlockedByOthersSwitch_Prop5_Dim0": F.col("ScheduledTasks") % 5 / 20, "TotalSwitch_Prop5_Dim0": (F.col("ScheduledTasks") % 3).cast("double")}
    return c.select("experiment", "run", "scheduler", "Time", *[x.alias(n) for n, x in at.items()])


@query(
    f"""with {INC_VIEW} select experiment, run, Time, round(u1 + b1, 4) as Prop2_Load, round(u2 + b2, 4) as Prop5_Load, case when t1 > 0 then 1.0 else 0.0 end::double as Prop2_Active, t1 + t2 as Total_Dim0,
round(((1 - u1 - b1) * t1 + (1 - u2 - b2) * t2) / (t1 + t2 + 0.01), 4) as Unused_Dim0 from wide""",
    "counters",
)
def e14_inc_load_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = mappers.inc_load_summary(inc_wide(spark, sf), dims=1)
    return rounded(out.select("experiment", "run", "Time", "Prop2_Load", "Prop5_Load", "Prop2_Active", "Total_Dim0", "Unused_Dim0"))


@query(
    f"""with {INC_VIEW}, a as (select experiment, run, Time, 100 * (1 - ((1 - u1 - b1) * t1 + (1 - u2 - b2) * t2) / (t1 + t2 + 0.01)) as SwitchDim0 from wide), b as (select experiment, run, Time, 100 * (CountJobs % 11) / 11.0 as s0, 100 * (CountPreemptions % 5) / 5.0 as s1 from counters)
select experiment, run, Time, round(SwitchDim0, 4) as SwitchDim0, round(s0, 4) as ServerDim0, round(s1, 4) as ServerDim1, round(SwitchDim0, 4) as SwitchBottleneck, round(greatest(s0, s1), 4) as ServerBottleneck from a join b using (experiment, run, Time)""",
    "counters",
)
def e15_resource_usage(spark: SparkSession, sf: str) -> DataFrame:
    inc = mappers.inc_load_summary(inc_wide(spark, sf).drop("scheduler"), dims=1).withColumn("Unused_Dim1", F.lit(1.0))
    cell = view(spark, sf, "counters").select("experiment", "run", "Time", (F.col("CountJobs") % 11 / 11).alias("UtilizationServersDim0"), (F.col("CountPreemptions") % 5 / 5).alias("UtilizationServersDim1"))
    return rounded(mappers.resource_usage(inc, cell, dims=2).drop("SwitchDim1"))


@query(
    f"""with tg as ({INC}), jobs as (select experiment, run, 100.0 * TotalJobsFullyScheduledINP / (1 + CountJobsWithInp) as j from counters qualify Time = max(Time) over (partition by experiment, run))
select experiment, run, AllocatedIncSuccess as TgIncSuccess, round(j, 4) as JobIncSuccess, round(100 * j / nullif(100.0 * TaskGroupsIncAllocated / TaskGroupsWithFlavor, 0), 2) as Completeness, round(100 - AllocatedIncSuccess, 4) as TgNotAllocated, round(100 - j, 4) as JobNotAllocated from tg join jobs using (experiment, run)""",
    "taskgroups",
    "counters",
)
def e16_tg_vs_job_success(spark: SparkSession, sf: str) -> DataFrame:
    tg = mappers.inc_tg_success(view(spark, sf, "taskgroups").withColumnRenamed("strategy", "scheduler-strategy"))
    return rounded(mappers.tg_vs_job_success(tg, mappers.success_ratios(view(spark, sf, "counters"))).withColumn("Completeness", F.round("Completeness", 2)))


@query(
    """select experiment, run, count(AvgQueueing) as count, round(avg(AvgQueueing), 4) as mean, round(stddev_samp(AvgQueueing), 4) as std, round(min(AvgQueueing), 4) as min, round(quantile_cont(AvgQueueing, 0.25), 4) as p25,
round(quantile_cont(AvgQueueing, 0.5), 4) as p50, round(quantile_cont(AvgQueueing, 0.75), 4) as p75, round(max(AvgQueueing), 4) as max from taskgroups group by experiment, run""",
    "taskgroups",
)
def e17_describe_by(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mappers.describe_by(view(spark, sf, "taskgroups"), ["experiment", "run"], "AvgQueueing"))


@query(
    """with spans as (select Solver, min(nanos) as low, (max(nanos) - min(nanos)) / 19.0 as step from solver group by Solver having min(nanos) < max(nanos)),
counts as (select Solver, cast(least(19, floor((nanos - low) / step + 1e-9)) as int) as bin, count(*) as n from solver join spans using (Solver) group by 1, 2)
select Solver, bin, round(low + bin * step, 4) as edge, coalesce(n, 0) as n from (select *, unnest(range(20))::int as bin from spans) left join counts using (Solver, bin)""",
    "solver",
)
def h1_auto_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(histogram.auto_histogram(view(spark, sf, "solver"), "nanos", ["Solver"], 20))


@query(
    """with spans as (select Solver, floor(log10(min(nanos) filter (where nanos > 0))) as low, (log10(max(nanos)) - floor(log10(min(nanos) filter (where nanos > 0)))) / 19.0 as step from solver group by Solver having min(nanos) < max(nanos)),
counts as (select Solver, cast(case when nanos <= 0 then 0 else least(19, floor((log10(nanos) - low) / step + 1e-9)) end as int) as bin, count(*) as n from solver join spans using (Solver) group by 1, 2)
select Solver, bin, round(pow(10, low + bin * step), 2) as edge, coalesce(n, 0) as n from (select *, unnest(range(20))::int as bin from spans) left join counts using (Solver, bin)""",
    "solver",
)
def h1_log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(histogram.auto_histogram(view(spark, sf, "solver"), "nanos", ["Solver"], 20, log=True), 2)


@query(
    """with u as (select experiment, run, value / 500 as v from runs), c as (select experiment, run, cast(least(floor(v * 20), 19) as int) as bin, count(*) as n from u where v between 0 and 1 group by 1, 2, 3)
select experiment, run, bin, round(bin / 20, 4) as edge, coalesce(n, 0) as n from (select distinct experiment, run from u) cross join (select unnest(range(20))::int as bin) left join c using (experiment, run, bin)""",
    "runs",
)
def h2_unit_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(histogram.unit_histogram(view(spark, sf, "runs").withColumn("v", F.col("value") / 500), "v", ["experiment", "run"], 20))


@query(
    f"""with {LATENCY}, spans as (select mu, min(log10(Latency)) filter (where Latency > 0) as low, max(log10(Latency)) filter (where Latency > 0) as high from latency group by mu),
c as (select mu, experiment, run, cast(case when Latency <= 0 then 0 else least(98, floor((log10(Latency) - low) / (high - low) * 99 + 1e-9)) end as int) as bin, count(*) as n from latency join spans using (mu) group by 1, 2, 3, 4),
d as (select *, coalesce(n, 0) as m from (select *, unnest(range(99))::int as bin from (select distinct mu, experiment, run, low, high from latency join spans using (mu))) left join c using (mu, experiment, run, bin))
select mu, experiment, run, bin, round(pow(10, low + bin * (high - low) / 99), 2) as edge, round(sum(m) over (partition by mu, experiment, run order by bin) / sum(m) over (partition by mu, experiment, run), 2) as cdf,
round(1 - sum(m) over (partition by mu, experiment, run order by bin) / sum(m) over (partition by mu, experiment, run), 2) as ccdf from d""",
    "taskgroups",
)
def h3_log_cdf(spark: SparkSession, sf: str) -> DataFrame:
    rows = mappers.placement_latency(view(spark, sf, "taskgroups"))
    return rounded(histogram.log_cdf(rows, "PlacementLatency", ["experiment", "run"], ["mu"]), 2)


@query(
    """with p as (select experiment, run, round(quantile_cont(AvgQueueing, 0.75), 4) as p75, round(quantile_cont(AvgQueueing, 0.9), 4) as p90, round(quantile_cont(AvgQueueing, 0.95), 4) as p95, quantile_cont(AvgQueueing, 0.99) as q99, count(AvgQueueing) as count, round(avg(AvgQueueing), 4) as mean from taskgroups group by experiment, run),
t as (select experiment, run, count(*) as tail_count, round(avg(SubmissionTime), 4) as tail_mean_time, min(SubmissionTime) as tail_first_time, max(SubmissionTime) as tail_last_time from taskgroups join p using (experiment, run) where AvgQueueing > q99 group by experiment, run)
select experiment, run, p75, p90, p95, round(q99, 4) as p99, count, mean, coalesce(tail_count, 0) as tail_count, tail_mean_time, tail_first_time, tail_last_time from p left join t using (experiment, run)""",
    "taskgroups",
)
def h4_tail_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(histogram.tail_report(view(spark, sf, "taskgroups"), "AvgQueueing", ["experiment", "run"]))


@query(
    """select Solver, min(nanos) as min, cast(sum(nanos) // count(*) as bigint) as mean, max(case when k = n // 2 + 1 then nanos end) as median, max(nanos) as max from (
select Solver, nanos, row_number() over (partition by Solver order by nanos) as k, count(*) over (partition by Solver) as n from solver) group by Solver""",
    "solver",
)
def h5_upper_median_stats(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.upper_median_stats(view(spark, sf, "solver"), "nanos", ["Solver"])


@query(
    f"""with {LATENCY}, spans as (select mu, min(log10(Latency)) as low, max(log10(Latency)) as high from latency where SubmissionTime >= 10000000 and JobStatus <> 'W' and Latency > 0 group by mu),
c as (select mu, scheduler, cast(case when Latency <= 0 then 0 else least(98, floor((log10(Latency) - low) / (high - low) * 99 + 1e-9)) end as int) as bin, count(*) as n from latency join spans using (mu) where SubmissionTime >= 10000000 and JobStatus <> 'W' group by 1, 2, 3),
d as (select *, coalesce(n, 0) as m from (select *, unnest(range(99))::int as bin from (select distinct mu, scheduler, low, high from c join spans using (mu))) left join c using (mu, scheduler, bin))
select mu, scheduler, bin, round(pow(10, low + bin * (high - low) / 99), 2) as edge, round(1 - sum(m) over (partition by mu, scheduler order by bin) / sum(m) over (partition by mu, scheduler), 2) as ccdf from d""",
    "taskgroups",
)
def latency_tail_by_scheduler(spark: SparkSession, sf: str) -> DataFrame:
    """Placement-latency tails of schedulers, for each share of in-network jobs, after warm-up and without withdrawn jobs."""
    rows = mappers.placement_latency(mappers.drop_withdrawn(mappers.after(view(spark, sf, "taskgroups"), 10_000_000)))
    return rounded(histogram.log_cdf(rows, "PlacementLatency", ["scheduler"], ["mu"]).drop("cdf"), 2)


@query("select scheduler, case when scheduler like '%hire%' then 'hire' when scheduler like '%resubmit%' then 'resubmit' when scheduler like '%greedy%' then 'greedy' else 'unknown' end as strategy, count(*) as rows from runs group by 1, 2", "runs")
def d2_scheduler_family(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "runs").groupBy("scheduler", scheduler_family(F.col("scheduler")).alias("strategy")).agg(F.count("*").alias("rows"))
