"""Queries: jobs, task groups and scheduler counters from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.expressions import definitely_in_flavor, might_be_in_flavor, ms_to_human
from tracelab.operators import mappers, tenant
from tracelab.plans.registry import query, rounded
from tracelab.plans.views import view

NOW, HOUR = 1_500_000_000, 3_600_000

#: Flavor choices of jobs, from allocations: bits 1..4 by how long an allocation ran.
JOB_EVENTS = """job_events as (select alloc_id as seq, start_time as time, case when alloc_id % 3 = 0 then 'flavor_removed' else 'flavor_chosen' end as event, job_id, 1 + num_tasks % 2 as bit from allocs)"""


def _job_events(spark: SparkSession, sf: str) -> DataFrame:
    bit = (1 + F.col("num_tasks") % 2).cast("int")
    rows = view(spark, sf, "allocs").select(F.col("alloc_id").alias("seq"), F.col("start_time").alias("time"), F.when(F.col("alloc_id") % 3 == 0, "flavor_removed").otherwise("flavor_chosen").alias("event"), "job_id", bit.alias("bit"))
    return rows.select("seq", "time", "event", "job_id", F.array("bit").alias("included"), F.array((3 - F.col("bit")).cast("int")).alias("excluded"))


OPTIONS = f"""{JOB_EVENTS}, last as (select job_id, side, bit, arg_max(event, seq) as event from (select job_id, 'c' as side, bit, event, seq from job_events where time <= {NOW} union all select job_id, 'x', 3 - bit, event, seq from job_events where time <= {NOW}) group by 1, 2, 3),
options as (select job_id, coalesce(list_sort(list(bit) filter (where side = 'c' and event = 'flavor_chosen')), []) as chosen, coalesce(list_sort(list(bit) filter (where side = 'x' and event = 'flavor_chosen')), []) as excluded from last group by job_id)"""


@query(f"with {OPTIONS} select job_id, array_to_string(chosen, ',') as chosen, array_to_string(excluded, ',') as excluded from options", "allocs")
def t1_job_options_at(spark: SparkSession, sf: str) -> DataFrame:
    out = tenant.job_options_at(_job_events(spark, sf), NOW)
    return out.select("job_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("chosen", "excluded")])


MIGHT = "(len(n) = 0 or (not list_has_any(n, chosen) and not list_has_any(i, excluded)))"


@query(
    f"""with {OPTIONS}, tgs as (select distinct job_id, tg_id, tg_id % 3 as k from allocs), j as (select tg_id, job_id, case k when 0 then [] when 1 then [1] else [2] end as i, case k when 0 then [] when 1 then [2] else [1] end as n, chosen, excluded from tgs join options using (job_id))
select tg_id, job_id, {MIGHT} as might_be, {MIGHT} and (len(n) = 0 or (list_has_any(i, chosen) and list_has_all(excluded, n))) as definitely from j""",
    "allocs",
)
def t2_flavor_membership(spark: SparkSession, sf: str) -> DataFrame:
    tgs = view(spark, sf, "allocs").select("job_id", "tg_id", *_tg_options()).distinct().join(tenant.job_options_at(_job_events(spark, sf), NOW), "job_id")
    four = [F.col(c) for c in ("in_option", "not_in_option", "chosen", "excluded")]
    return tgs.select("tg_id", "job_id", might_be_in_flavor(*four).alias("might_be"), definitely_in_flavor(*four).alias("definitely"))


def _tg_options() -> list:
    none, k = F.array().cast("array<int>"), F.col("tg_id") % 3
    return [F.when(k == 0, none).when(k == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(2))).alias("in_option"), F.when(k == 0, none).when(k == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(1))).alias("not_in_option")]


STATUS = f"""status as (select job_id, case when bool_or(alloc_id % 101 = 0) then 'W' when count(*) filter (where end_time <= {NOW}) > 40 then 'D' when sum(num_tasks) >= 60 then 'A' else 'O' end as JobStatus from allocs where start_time <= {NOW} group by job_id)"""


@query(f"with {STATUS} select * from status", "allocs")
def t3_job_status_at(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf)


def _status(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "allocs").where(F.col("start_time") <= NOW)
    facts = rows.groupBy("job_id").agg(F.bool_or(F.col("alloc_id") % 101 == 0).alias("w"), F.count_if(F.col("end_time") <= NOW).alias("e"), F.sum("num_tasks").alias("n"))
    event = F.when(F.col("w"), "withdraw").when(F.col("e") > 40, "done").otherwise("submit")
    log = facts.select("job_id", F.lit(0).alias("time"), event.alias("event"))
    return tenant.job_status_at(log, facts.select("job_id", F.lit(60).alias("total"), F.col("n").alias("started")), NOW)


@query(f"with {OPTIONS} select job_id, case when job_id % 5 = 0 then 'S' when list_contains(chosen, 2) then 'Y' else 'N' end as InpStatus from options", "allocs")
def t4_inp_status(spark: SparkSession, sf: str) -> DataFrame:
    every = F.when(F.col("job_id") % 5 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    return tenant.job_options_at(_job_events(spark, sf), NOW).select("job_id", tenant.inp_status(every, F.col("chosen")).alias("InpStatus"))


TGSTATS = f"""{OPTIONS}, {STATUS}, tgs as (select tg_id, max(job_id) as job_id, min(start_time) - 1000 as submitted, cast(sum(num_tasks) as bigint) as num_tasks, max(cpu) * 1000 as duration from allocs group by tg_id),
begun as (select tg_id, sum(num_tasks) as s, sum(start_time * num_tasks) as w, max(start_time) as last from allocs where start_time <= {NOW} and alloc_id % 10 <> 0 group by tg_id),
j as (select t.*, coalesce(chosen, []) as chosen, coalesce(excluded, []) as excluded, coalesce(JobStatus, 'O') as JobStatus, case when JobStatus = 'W' then 0 else coalesce(s, 0) end as started, case when JobStatus = 'W' then 0 else coalesce(w, 0) end as weighted, case when JobStatus = 'W' then -1 else coalesce(last, -1) end as last,
case tg_id % 3 when 0 then [] when 1 then [1] else [2] end as i, case tg_id % 3 when 0 then [] when 1 then [2] else [1] end as n from tgs t left join options using (job_id) left join status using (job_id) left join begun using (tg_id) where submitted <= {NOW}),
stats as (select job_id as JobID, JobStatus, case when len(i) = 0 then 'A' when list_contains(i, 2) then 'Y' else 'N' end as FlavorInp, 'Y' as ValidForJob, tg_id as TaskGroupID, submitted as SubmissionTime, num_tasks as TotalTasks, 'S' as TaskGroupType, cast(started as bigint) as TasksStarted,
(weighted - started * submitted + ({NOW} - submitted) * (num_tasks - started)) / num_tasks as AvgQueueing, cast(last as bigint) as PlacementLatency, duration as Duration, duration as OriginalDuration from j where {MIGHT})"""


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "allocs")
    tgs = rows.groupBy("tg_id").agg(F.max("job_id").alias("job_id"), (F.min("start_time") - 1000).alias("submitted"), F.sum("num_tasks").alias("num_tasks"), (F.max("cpu") * 1000).alias("duration"))
    tgs = tgs.select("*", F.lit(False).alias("is_switch"), F.col("duration").alias("original_duration"), *_tg_options())
    allocs = rows.withColumn("preempted", F.col("alloc_id") % 10 == 0)
    options = tenant.job_options_at(_job_events(spark, sf), NOW).join(_status(spark, sf), "job_id", "full")
    return tenant.taskgroup_stats(allocs, tgs, options.withColumn("JobStatus", F.coalesce("JobStatus", F.lit("O"))), NOW)


@query(f"with {TGSTATS} select * replace (round(AvgQueueing, 2) as AvgQueueing) from stats", "allocs")
def t5_taskgroup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_stats(spark, sf), 2)


@query(
    f"""with {TGSTATS} select JobID, JobStatus, count(*) as InvolvedTGCnt, cast(sum(TotalTasks) as bigint) as TasksTotal, cast(sum(TasksStarted) as bigint) as TasksStarted, round(sum(AvgQueueing * TotalTasks) / greatest(1, sum(TotalTasks)), 2) as AvgTaskQueueing,
round(sum(Duration * TotalTasks) / greatest(1, sum(TotalTasks)), 2) as AvgTaskDuration, round(sum(OriginalDuration * TotalTasks) / greatest(1, sum(TotalTasks)), 2) as AvgTaskDurationOriginal,
any_value((select case when s.JobID % 5 = 0 then 'S' when list_contains(o.chosen, 2) then 'Y' else 'N' end from options o where o.job_id = s.JobID)) as InpStatus from stats s group by 1, 2""",
    "allocs",
)
def t6_job_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tenant.job_stats(_stats(spark, sf), t4_inp_status(spark, sf)), 2)


@query(
    f"""with t as (select h as hour, h * {HOUR} as now from (select unnest([24, 48, 240]) as h)), tgs as (select tg_id, min(start_time) - 1000 as submitted, sum(num_tasks) as n from allocs group by tg_id),
b as (select hour, tg_id, sum(num_tasks) as started from allocs, t where start_time <= now and alloc_id % 10 <> 0 group by 1, 2)
select cast(hour as int) as hour, tg_id, cast(coalesce(started, 0) as bigint) as started, cast(n - coalesce(started, 0) as bigint) as waiting from tgs cross join t left join b using (hour, tg_id) where submitted <= now""",
    "allocs",
)
def t7_tenant_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "allocs")
    tgs = rows.groupBy("tg_id").agg((F.min("start_time") - 1000).alias("submitted"), F.sum("num_tasks").alias("num_tasks"))
    return tenant.tenant_snapshots(rows.withColumn("preempted", F.col("alloc_id") % 10 == 0), tgs, [24, 48, 240])


TICK = f"cast(ceil(time / {HOUR}.0) as bigint) * {HOUR}"


#: What each log adds to the counters.
COUNTS = f"""states as (select *, coalesce(last_value(case event when 'flavor_chosen' then bit = 2 when 'flavor_removed' then false end ignore nulls) over j, false) as inp, count(*) filter (where event = 'scheduled') over j as ns, count(*) filter (where event in ('scheduled', 'withdraw')) over j as nl, min(case when event = 'submit' then time end) over j as t0
from job_log window j as (partition by run, job_id order by time, seq rows between unbounded preceding and current row)),
added as (select cast(machine_id % 4 as int) as run, {TICK} as Time, cast(event = 'claim' as int) as Allocations, case when event = 'claim' then num_tasks else 0 end as ScheduledTasks, case when event = 'preempt' then num_tasks else 0 end as CountPreemptions from alloc_events
union all by name select cast(tg_id % 4 as int) as run, cast(ceil(start_time / {HOUR}.0) as bigint) * {HOUR} as Time, 1 as Attempts, case when alloc_id % 4 > 0 then cpu else 0 end as ThinkTime, case when alloc_id % 4 = 0 then cpu else 0 end as ThinkTimeWasted from allocs
union all by name select run, {TICK} as Time, cast(event = 'scheduled' and ns = 1 as int) as TotalJobsFullyScheduled, cast(event = 'scheduled' and ns = 1 and inp as int) as TotalJobsFullyScheduledINP, case when event = 'scheduled' and ns = 1 then time - t0 else 0 end as TotalJobQueueTime,
cast(event = 'submit' as int) as CountJobs, cast(event = 'submit' and has_inp as int) as CountJobsWithInp, cast(event = 'done' as int) as CountJobsFinished, cast(event = 'done' and inp as int) as CountJobsFinishedINP,
case when event = 'submit' then 1 when event in ('scheduled', 'withdraw') and nl = 1 then -1 else 0 end as PendingJobsNotFullyScheduledPlusFutureTgSubmissions, cast(event = 'resubmit' as int) as TimesServerFallbackResubmit,
case when bit = 2 then 0 when event = 'flavor_chosen' then 1 when event = 'flavor_removed' then -1 else 0 end as TimesServerFlavorTaken, case when bit <> 2 then 0 when event = 'flavor_chosen' then 1 when event = 'flavor_removed' then -1 else 0 end as TimesSwitchFlavorTaken from states),
summed as (select run, Time, {", ".join(f"sum({c}) as {c}" for c in tenant.COUNTERS)} from added group by 1, 2), span as (select unnest(range((select min(Time) from added), (select max(Time) from added) + 1, {HOUR})) as Time),
totals as (select run, Time, {", ".join(f"cast(sum(coalesce({c}, 0)) over w as bigint) as {c}" for c in tenant.COUNTERS)} from (select distinct run from added) cross join span left join summed using (run, Time) window w as (partition by run order by Time)),
ends as (select run, job_id, min(submitted) as since, case when bool_or(full_time is null) then null else max(full_time) end as until from job_groups group by 1, 2),
at_ticks as (select run, job_id, Time, since, until, max(case when submitted <= Time and (full_time is null or full_time > Time) then 1 else 0 end) as waits from ends join job_groups using (run, job_id) join span on Time >= since and (until is null or Time < until) group by all),
waiting as (select run, Time, sum(waits) as PendingJobsNotFullyScheduled, sum(1 - waits) as PendingJobsFullyScheduled from at_ticks group by 1, 2),
log_counters as (select totals.*, cast(coalesce(PendingJobsNotFullyScheduled, 0) as bigint) as PendingJobsNotFullyScheduled, cast(coalesce(PendingJobsFullyScheduled, 0) as bigint) as PendingJobsFullyScheduled from totals left join waiting using (run, Time))"""


def _log_counters(spark: SparkSession, sf: str) -> DataFrame:
    jobs = view(spark, sf, "job_log")
    jobs = jobs.select("run", "seq", "time", "event", "job_id", F.when(F.col("has_inp"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("options"), F.array("bit").alias("included"))
    run = lambda c: (F.col(c) % 4).cast("int").alias("run")
    sched = view(spark, sf, "allocs").select(run("tg_id"), F.col("start_time").alias("time"), F.lit("attempt").alias("event"), F.col("cpu").alias("think_time"), (F.col("alloc_id") % 4).alias("allocations"))
    groups = view(spark, sf, "job_groups")
    pending = tenant.pending_jobs(groups.select("run", "job_id", "tg_id", "submitted"), groups.where("full_time is not null").select("run", "tg_id", "full_time"), HOUR, ["run"])
    return tenant.scheduler_counters(view(spark, sf, "alloc_events").withColumn("run", run("machine_id")), jobs, sched, HOUR, pending=pending)


@query(f"with {COUNTS} select * from log_counters", "alloc_events", "job_log", "job_groups")
def t8_scheduler_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _log_counters(spark, sf)


@query(f"with {COUNTS} select run, Time, TimesServerFlavorTaken + TimesSwitchFlavorTaken + TimesServerFallbackResubmit + CountJobs - TotalJobsFullyScheduled - PendingJobsFullyScheduled as CountJobsWithInp from log_counters", "alloc_events", "job_log", "job_groups")
def e6_inc_job_count_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """The substitute for a counter that old files lack, on counters of the event log."""
    return mappers.inc_job_count(_log_counters(spark, sf).drop("CountJobsWithInp")).select("run", "Time", "CountJobsWithInp")


@query(
    f"""with {COUNTS} select run, Time, CountJobs - TimesServerFallbackResubmit as EffectiveCountJobs, round(100.0 * TotalJobsFullyScheduledINP / (1 + CountJobsWithInp), 4) as AllocatedIncSuccess, round(100.0 * TimesSwitchFlavorTaken / (1 + CountJobsWithInp), 4) as RollingIncTaken,
round(100.0 * CountPreemptions / nullif(ScheduledTasks + CountPreemptions, 0), 4) as WastedAllocations, round(100.0 * (TotalJobsFullyScheduled + PendingJobsFullyScheduled) / nullif(CountJobs - TimesServerFallbackResubmit, 0), 4) as SchedulingSuccess from log_counters""",
    "alloc_events", "job_log", "job_groups",
)
def e7_success_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """From event logs to success ratios, without a file between."""
    return rounded(mappers.success_ratios(_log_counters(spark, sf)).select("run", "Time", "EffectiveCountJobs", "AllocatedIncSuccess", "RollingIncTaken", "WastedAllocations", "SchedulingSuccess"))


#: Groups of a day: submitted a while before an allocation starts, placed when it does; some never.
WAITS = "waits as (select tg_id * 1000000 + alloc_id as tg_id, job_id * 100 + cast(floor(start_time / 86400000) as bigint) as job_id, start_time - 3000000 * (1 + alloc_id % 5) as submitted, case when alloc_id % 50 = 0 then null else start_time end as full_time from allocs)"


def _waits(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("alloc_id")
    return view(spark, sf, "allocs").select((F.col("tg_id") * 1_000_000 + a).alias("tg_id"), (F.col("job_id") * 100 + F.floor(F.col("start_time") / 86_400_000)).alias("job_id"), (F.col("start_time") - 3_000_000 * (1 + a % 5)).alias("submitted"), F.when(a % 50 != 0, F.col("start_time")).alias("full_time"))


@query(
    f"""with {WAITS}, j as (select job_id, min(submitted) as since, case when bool_or(full_time is null) then null else max(full_time) end as u from waits group by 1),
m as (select job_id, time, sum(d) as d from (select job_id, submitted as time, 1 as d from waits union all select job_id, full_time, -1 from waits where full_time is not null) group by 1, 2),
s as (select job_id, time, sum(d) over (partition by job_id order by time) as waiting, lead(time) over (partition by job_id order by time) as nxt from m),
sp as (select waiting = 0 as placed, time as since, case when nxt is null then u when u is null then nxt else least(nxt, u) end as u from s join j using (job_id) where u is null or time < u),
e as (select placed, cast(ceil(since / {HOUR}.0) as bigint) * {HOUR} as tick, 1 as n from sp union all select placed, cast(ceil(u / {HOUR}.0) as bigint) * {HOUR}, -1 from sp where u is not null), g as (select unnest(range((select min(tick) from e), (select max(tick) from e) + 1, {HOUR})) as tick), x as (select placed, tick, sum(n) as n from e group by 1, 2)
select placed, tick, cast(sum(coalesce(n, 0)) over (partition by placed order by tick) as bigint) as n from (select distinct placed from e) cross join g left join x using (placed, tick)""",
    "allocs",
)
def t9_pending_jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _waits(spark, sf)
    return tenant.pending_jobs(rows.select("job_id", "tg_id", "submitted"), rows.where("full_time is not null").select("tg_id", "full_time"), HOUR)


@query(
    f"""with {WAITS}, s as (select submitted, cast(ceil(submitted / {HOUR}.0) as bigint) as a, cast(ceil(full_time / {HOUR}.0) as bigint) - 1 as b from waits where full_time is not null)
select t * {HOUR} as tick, coalesce(t * {HOUR} - oldest, 0) as waiting from (select unnest(range((select min(a) from s), (select max(b) from s) + 2)) as t) left join (select t, min(submitted) as oldest from (select submitted, unnest(range(a, b + 1)) as t from s where a <= b) group by t) using (t)""",
    "allocs",
)
def t10_max_waiting_time(spark: SparkSession, sf: str) -> DataFrame:
    return tenant.max_waiting_time(_waits(spark, sf).where("full_time is not null").select("submitted", F.col("full_time").alias("until")), HOUR)


RECENT = "with r as (select *, row_number() over (partition by Solver order by StartTimeNanos desc) as k from solver), x as (select Solver, nanos, row_number() over (partition by Solver order by nanos) as p, count(*) over (partition by Solver) as n from r where k <= 1000"


@query(f"{RECENT}) select Solver, min(nanos) as min, cast(sum(nanos) // count(*) as bigint) as mean, max(case when p = n // 2 + 1 then nanos end) as median, max(nanos) as max from x group by Solver", "solver")
def t11_recent_latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tenant.recent_latency_stats(view(spark, sf, "solver"), ["Solver"], "nanos", ["StartTimeNanos"])


@query(
    """with l as (select * from counters qualify Time = max(Time) over (partition by experiment, run)), x as (select experiment, run, unnest(['success', 'preemptions']) as statistic, unnest([100.0 * TotalJobsFullyScheduled / CountJobs, cast(CountPreemptions as double)]) as value from l)
select experiment, run, statistic, round(value, 4) as value from x""",
    "counters",
)
def t12_quick_summary(spark: SparkSession, sf: str) -> DataFrame:
    last = mappers.last_measurement(view(spark, sf, "counters"))
    return rounded(tenant.quick_summary(last, ["experiment", "run"], {"success": 100 * F.col("TotalJobsFullyScheduled") / F.col("CountJobs"), "preemptions": F.col("CountPreemptions")}))


@query(
    """with g as (select * from solver where nanos > 0), r as (select *, row_number() over (partition by Solver order by StartTimeNanos desc) as k from g), x as (select Solver, nanos, row_number() over (partition by Solver order by nanos) as p, count(*) over (partition by Solver) as n from r where k <= 1000),
t as (select Solver, count(*) as entries, cast(floor(sum(nanos) / 1000) as bigint) as total_ms from g group by 1)
select Solver, min(nanos) as min, cast(sum(nanos) // count(*) as bigint) as mean, max(case when p = n // 2 + 1 then nanos end) as median, max(nanos) as max, any_value(entries) as entries, any_value(total_ms) as total_ms from x join t using (Solver) group by Solver""",
    "solver",
)
def t13_timer_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tenant.timer_stats(view(spark, sf, "solver"), "Solver", "nanos", "StartTimeNanos")


@query("select experiment, run, ProducerCnt, coalesce(max(nanos) filter (where Solver = 'click'), -1) as click, coalesce(max(nanos) filter (where Solver = 'error'), -1) as error, coalesce(max(nanos) filter (where Solver = 'view'), -1) as view from solver group by 1, 2, 3", "solver")
def t14_round_timings(spark: SparkSession, sf: str) -> DataFrame:
    return tenant.round_timings(view(spark, sf, "solver"), ["experiment", "run", "ProducerCnt"], "Solver", "nanos", ["click", "error", "view"])


@query("select alloc_id, printf('%d:%02d:%02d.%03d', start_time // 3600000, start_time // 60000 % 60, start_time // 1000 % 60, start_time % 1000) as human from allocs", "allocs")
def t15_ms_to_human(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "allocs").select("alloc_id", ms_to_human(F.col("start_time")).alias("human"))


@query(
    """with d as (select *, Time - lag(Time) over w as s, event_id - lag(event_id) over w as u from runs window w as (partition by experiment, run order by event_id)), m as (select *, u / s as speed, row_number() over (partition by experiment, run order by event_id desc) as k from d where s > 0 and u > 0),
r as (select *, row_number() over (partition by experiment, run order by speed) as p, count(*) over (partition by experiment, run) as n from m where k <= 10), s as (select experiment, run, max(case when p = n // 2 + 1 then speed end) as speed from r group by 1, 2), a as (select experiment, run, max(Time) as latest from runs group by 1, 2)
select experiment, run, round(speed, 9) as speed, round(speed * (3000000000 - latest), 2) as remaining_us from s join a using (experiment, run)""",
    "runs",
)
def t16_recent_speed(spark: SparkSession, sf: str) -> DataFrame:
    out = tenant.recent_speed(view(spark, sf, "runs"), ["experiment", "run"], "Time", "event_id", 3_000_000_000)
    return out.withColumns({"speed": F.round("speed", 9), "remaining_us": F.round("remaining_us", 2)})


@query("select job_id, count(distinct time) as preemptions, max(time) as last_preemption, cast(sum(num_tasks) as bigint) as preempted_tasks from alloc_events where event = 'preempt' group by job_id", "alloc_events")
def t17_preemption_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tenant.preemption_counts(view(spark, sf, "alloc_events"))




LAST = 750 * HOUR
#: Groups with options, and what jobs choose and give up: both from allocations.
FLAVORS = f"""{WAITS}, groups as (select *, case tg_id % 3 when 0 then [] when 1 then [1] else [2] end as i, case tg_id % 3 when 0 then [] when 1 then [2] else [1] end as n from waits),
told as (select job_id * 100 + cast(floor(start_time / 86400000) as bigint) as job_id, alloc_id as seq, start_time - 2000000 * (alloc_id % 3) as time, alloc_id % 9 <> 8 as chosen, 1 + job_id % 2 as bit from allocs where alloc_id % 4 < 3),
bits as (select job_id, seq, time, chosen, 'c' as side, bit from told union all select job_id, seq, time, chosen, 'x', 3 - bit from told),
born as (select job_id, min(submitted) as since from groups group by job_id), gone as (select job_id * 100 + cast(floor(start_time / 86400000) as bigint) as job_id, min(start_time) + 1000 as left_at from allocs where alloc_id % 37 = 0 group by 1),
span as (select unnest(range((select cast(ceil(min(submitted) / {HOUR}.0) as bigint) from groups), {LAST // HOUR + 1})) * {HOUR} as tick),
times as (select distinct job_id, time, false as is_tick from (select job_id, since as time from born union all select job_id, submitted from groups union all select job_id, full_time from groups where full_time is not null union all select job_id, time from told) join born using (job_id) where time >= since union all select job_id, tick, true from born join span on tick >= since),
word as (select job_id, t.time, side, bit, arg_max(chosen, (b.time, seq)) as is_on from (select distinct job_id, time from times) t join bits b using (job_id) where b.time <= t.time group by all),
held as (select job_id, time, list(bit) filter (where side = 'c' and is_on) as c, list(bit) filter (where side = 'x' and is_on) as x from word group by all),
state as (select t.job_id, t.time, t.is_tick, count(*) filter (where lacks) as lacks, count(*) filter (where lacks and submitted <= t.time) as ready from (
select times.job_id, times.time, is_tick, submitted, (full_time is null or full_time > times.time) and (len(n) = 0 or (not list_has_any(n, coalesce(c, [])) and not list_has_any(i, coalesce(x, [])))) as lacks from times join groups using (job_id) left join held on held.job_id = times.job_id and held.time = times.time) t group by all),
ended as (select job_id, min(time) as until from (select job_id, time from state where lacks = 0 and not is_tick union all select job_id, left_at from gone) group by 1)"""


@query(f"with {FLAVORS} select (ready = 0) as placed, time as tick, count(*) as n from state left join ended using (job_id) where is_tick and time <= {LAST} and (until is null or time < until) group by 1, 2", "allocs")
def t9_pending_in_flavor(spark: SparkSession, sf: str) -> DataFrame:
    """Groups count while they might be in the flavor that their job has chosen by then; some jobs are withdrawn."""
    rows = view(spark, sf, "allocs")
    day = (F.col("job_id") * 100 + F.floor(F.col("start_time") / 86_400_000)).alias("job_id")
    tgs = _waits(spark, sf)
    bit = (1 + F.col("job_id") % 2).cast("int")
    told = rows.where(F.col("alloc_id") % 4 < 3).select(day, F.col("alloc_id").alias("seq"), (F.col("start_time") - 2_000_000 * (F.col("alloc_id") % 3)).alias("time"), F.when(F.col("alloc_id") % 9 != 8, "flavor_chosen").otherwise("flavor_removed").alias("event"), F.array(bit).alias("included"), F.array((3 - bit).cast("int")).alias("excluded"))
    gone = rows.where(F.col("alloc_id") % 37 == 0).groupBy(day).agg((F.min("start_time") + 1000).alias("time"))
    placed = tgs.where("full_time is not null").select("tg_id", "full_time")
    found = tenant.pending_jobs(tgs.select("job_id", "tg_id", "submitted", *_tg_options()), placed, HOUR, options=told, withdrawn=gone, last=LAST)
    return found.where("n > 0")


WITHDRAWN = "gone as (select job_id, min(start_time) + 5000 as withdrawn from allocs where alloc_id % 211 = 7 group by 1 union all select job_id + 1000, 1 from (select distinct job_id from allocs where job_id % 10 = 3))"


@query(
    f"""with {WITHDRAWN}, e as (select a.*, withdrawn from alloc_events a left join gone using (job_id) where withdrawn is null or time <= withdrawn),
alive as (select c.job_id, cast(sum(c.num_tasks) as bigint) as running from e c where c.event = 'claim' and c.withdrawn is not null and not exists (select 1 from e d where d.alloc_id = c.alloc_id and d.event <> 'claim') group by 1),
times as (select job_id, time from e where event = 'preempt' union select job_id, withdrawn from gone join alive using (job_id) where running > 0),
p as (select job_id, count(distinct time) as preemptions, max(time) as last from times group by 1), t as (select job_id, sum(case when event = 'preempt' then num_tasks else 0 end) + sum(case when event = 'claim' and withdrawn is not null then num_tasks else 0 end) as tasks from e group by 1)
select job_id, coalesce(preemptions, 0) as preemptions, coalesce(withdrawn, last) as last_preemption, cast(coalesce(tasks, 0) as bigint) as preempted_tasks, coalesce(running, 0) as withdrawn_tasks from t full join gone using (job_id) left join p using (job_id) left join alive using (job_id) where coalesce(withdrawn, last) is not null""",
    "alloc_events",
)
def t17_preemptions_and_withdraws(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "allocs")
    gone = rows.where("alloc_id % 211 = 7").groupBy("job_id").agg((F.min("start_time") + 5000).alias("time")).unionByName(rows.where("job_id % 10 = 3").select(F.col("job_id") + 1000, F.lit(1).cast("bigint").alias("time")).toDF("job_id", "time").distinct())
    return tenant.preemption_counts(view(spark, sf, "alloc_events"), gone.withColumn("event", F.lit("withdraw")))
