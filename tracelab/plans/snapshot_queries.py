"""Queries: the tables of tenants as of several times, with locality in a fat tree."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.expressions import definitely_in_flavor, might_be_in_flavor
from tracelab.operators import snapshots, tenant
from tracelab.plans import paper_frames
from tracelab.plans.registry import query, rounded
from tracelab.plans.topology_queries import HOPS, K
from tracelab.plans.views import DUCK, SPARK
from tracelab.sources.scratch import materialize
from tracelab.sources.topology import fat_tree

DAY = 86_400_000
TIMES = (2 * DAY, 5 * DAY, 5 * DAY, 12 * DAY, 40 * DAY)
#: Three groups for each user, which is a job: one in all flavors, one on switches, one on servers instead. A day after their last start some jobs end, some before.
TABLES = """a as (select user_id as job_id, user_id * 3 + event_id % 3 as tg_id, case when event_id % 3 = 1 then user_id * 7 % 20 + event_id % 5 * 2 else event_id % 16 end % 20 as machine_id, MS(ts) as start_time, 1 + event_id % 3 as num_tasks, event_id as alloc_id, case when event_id % 7 = 0 and user_id % 2 = 0 then MS(ts) + cast(floor(value * 2000000) as bigint) end as lost from events),
g as (select tg_id, max(job_id) as job_id, min(start_time) - 1000000 as submitted, cast(sum(num_tasks) as bigint) + tg_id % 2 as num_tasks, tg_id % 3 = 1 as is_switch, 1000 + tg_id as duration, 2000 + tg_id as original from a group by tg_id),
told as (select job_id, alloc_id as seq, start_time as time, alloc_id % 13 <> 0 as chosen, 1 + (job_id + cast(floor(start_time / 900000000) as bigint)) % 2 as bit from a where alloc_id % 5 = 0),
over_ as (select job_id, max(start_time) - job_id % 4 * 600000000 as until, case when job_id % 4 = 3 then 'W' else 'D' end as kind from a where job_id % 3 > 0 group by job_id)"""


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sql = re.sub(r"\bMS\((\w+)\)", SPARK["MS"], TABLES)
    return spark.sql(f"with {sql.replace('from events', f'from parquet.`{sf}/events.parquet`')} select * from {name}")


def _duck() -> str:
    return re.sub(r"\bMS\((\w+)\)", DUCK["MS"], TABLES)


def _tgs(spark: SparkSession, sf: str) -> DataFrame:
    k, none, bits = F.col("tg_id") % 3, F.array().cast("array<int>"), lambda b: F.array(F.lit(b))
    option = lambda one, two: F.when(k == 0, none).when(k == 1, bits(one)).otherwise(bits(two))
    return _table(spark, sf, "g").withColumnRenamed("original", "original_duration").withColumns({"in_option": option(2, 1), "not_in_option": option(1, 2)})


def _edges(tgs: DataFrame) -> DataFrame:
    j = F.col("job_id") * 3
    pairs = F.array(F.struct(j.alias("src_tg"), (j + 1).alias("dst_tg")), F.struct((j + 1).alias("src_tg"), (j + 2).alias("dst_tg")), F.struct(j.alias("src_tg"), (j + 2).alias("dst_tg")))
    return tgs.select("job_id").distinct().select(F.inline(pairs))


def _job_events(spark: SparkSession, sf: str) -> DataFrame:
    bit = F.col("bit").cast("int")
    none = F.array().cast("array<int>")
    told = _table(spark, sf, "told").select("job_id", "seq", "time", F.when(F.col("chosen"), "flavor_chosen").otherwise("flavor_removed").alias("event"), F.array(bit).alias("included"), F.array((3 - bit).cast("int")).alias("excluded"))
    ends = _table(spark, sf, "over_").select("job_id", F.lit(0).cast("bigint").alias("seq"), F.col("until").alias("time"), F.when(F.col("kind") == "W", "withdraw").otherwise("done").alias("event"), none.alias("included"), none.alias("excluded"))
    return told.unionByName(ends)


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tgs = materialize(_tgs(spark, sf), "tgs")
    allocs = _table(spark, sf, "a").withColumnRenamed("lost", "preempted_at")
    every = F.when(F.col("job_id") % 5 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    return snapshots.tenant_tables(tgs, allocs, _job_events(spark, sf), TIMES, tgs.select("job_id", every.alias("all_options")).distinct(), _edges(tgs), *fat_tree(spark, K))


def _state_sql(times: tuple[int, ...], ends: bool = True) -> str:
    """Everything as of each snapshot, straight from the log: no sums are carried."""
    over = "over_" if ends else "(select * from over_ where false)"
    return f"""{_duck()}, {HOPS},
snaps as (select distinct unnest({list(times)}) as snapshot), born as (select job_id, min(submitted) as first_ from g group by 1),
pts as (select snapshot, job_id, case when until <= snapshot then until else snapshot end as at_, case when until <= snapshot then kind end as kind from snaps cross join born left join {over} o using (job_id) where first_ <= case when until <= snapshot then until else snapshot end or until <= snapshot),
word as (select snapshot, job_id, side, bit, arg_max(chosen, (time, seq)) as is_on from pts join (select job_id, seq, time, chosen, 'c' as side, bit from told union all select job_id, seq, time, chosen, 'x', 3 - bit from told) using (job_id) where time <= at_ group by all),
opt as (select pts.*, coalesce(list(bit) filter (where side = 'c' and is_on), []) as c, coalesce(list(bit) filter (where side = 'x' and is_on), []) as x from pts left join word using (snapshot, job_id) group by all),
live as (select snapshot, a.* from a join pts using (job_id) where start_time <= at_ and (lost is null or lost > at_)),
sums as (select snapshot, tg_id, sum(num_tasks) as s, sum(start_time::hugeint * num_tasks) as w, max(start_time) as last from live group by all),
f as (select g.*, opt.snapshot, at_, kind, c, coalesce(s, 0) as s, coalesce(w, 0) as w, last, case tg_id % 3 when 0 then [] when 1 then [2] else [1] end as i, case tg_id % 3 when 0 then [] when 1 then [1] else [2] end as n, len(n) = 0 or (not list_has_any(n, c) and not list_has_any(i, x)) as might, might and (len(n) = 0 or (list_has_any(i, c) and list_has_all(x, n))) as surely from g join opt using (job_id) left join sums using (snapshot, tg_id)),
st as (select *, coalesce(kind, case when sum(case when might then num_tasks - s else 0 end) over (partition by snapshot, job_id) <= 0 then 'A' else 'O' end) as status from f),
rows_ as (select *, case when status = 'W' then 0 else s end as started, case when status = 'W' then 0 else w end as weight from st where submitted <= at_),
edges as (select src, dst from (select distinct job_id * 3 as j from g) cross join (select unnest([0, 1, 0]) as p, unnest([1, 2, 2]) as q) cross join lateral (select j + p as src, j + q as dst)),
pl as (select distinct snapshot, tg_id, machine_id, tg_id % 3 = 1 as sw, case when tg_id % 3 = 1 then machine_id else 12 + machine_id // 2 end as switch from live join pts using (snapshot, job_id) where coalesce(kind, '') <> 'W'),
ok as (select r.snapshot, src, dst from edges join rows_ r on r.tg_id = dst where surely),
rack as (select snapshot, tg_id, count(distinct switch) as racks from pl group by all),
far as (select ok.snapshot, src as tg_id, max(case when o.switch <> q.switch then hops + case when q.sw then 0 else 1 end else 0 end) as m from ok join pl o on o.snapshot = ok.snapshot and o.tg_id = src join pl q on q.snapshot = ok.snapshot and q.tg_id = dst join hops h on h.a = o.switch and h.b = q.switch group by all),
anyok as (select distinct snapshot, src as tg_id from ok),
sides as (select snapshot, tg_id, machine_id, sw from pl union select ok.snapshot, src, q.machine_id, q.sw from ok join pl q on q.snapshot = ok.snapshot and q.tg_id = dst where q.sw <> (src % 3 = 1)),
lv as (select t as switch, case when t < 4 then 2 when t < 12 then 1 else 0 end as level from (select unnest(range(20)) as t)),
reach as (select t as switch, v as server from (select unnest(range(20)) as t) cross join (select unnest(range(16)) as v) where t < 4 or (t between 4 and 11 and (t - 4) // 2 = v // 4) or t = 12 + v // 2),
dv as (select snapshot, tg_id, machine_id as server from sides where not sw), dw as (select snapshot, tg_id, machine_id as switch, level, max(level) over (partition by snapshot, tg_id) as top from sides join lv on switch = machine_id where sw),
u1 as (select distinct snapshot, tg_id, b as switch from dw join links on a = switch where level = top), u2 as (select distinct snapshot, tg_id, b as switch from u1 join links on a = switch),
kn as (select snapshot, tg_id, switch, 0 as lift from dw union all select snapshot, tg_id, switch, 1 from u1 union all select snapshot, tg_id, switch, 2 from u2),
cv as (select snapshot, tg_id, server, min(lift) as lift from kn join reach using (switch) join dv using (snapshot, tg_id, server) group by all), nd as (select snapshot, tg_id, count(*) as met, max(lift) as need from cv group by all),
wt as (select snapshot, tg_id, count(*) as wanted from dv group by all), tp as (select distinct snapshot, tg_id, top from dw),
groups_ as (select snapshot, job_id as JobID, status as JobStatus, case when len(i) = 0 then 'A' when list_contains(i, 2) then 'Y' else 'N' end as FlavorInp, 'Y' as ValidForJob, tg_id as TaskGroupID, submitted as SubmissionTime, num_tasks as TotalTasks, case when is_switch then 'I' else 'S' end as TaskGroupType, started::bigint as TasksStarted,
(weight - started * submitted::hugeint + (at_ - submitted) * (num_tasks - started)) / num_tasks as AvgQueueing, case when status = 'W' then -1 else coalesce(last, -1) end::bigint as PlacementLatency, duration as Duration, original as OriginalDuration,
coalesce(case when top is null or wanted is null then -1 when met = wanted then need else 4 - top end, -1)::double as DetourInc, coalesce(racks, 0)::double as InvolvedRacks, case when anyok.tg_id is not null then coalesce(m, 0) + case when is_switch then 0 else 1 end else -1 end::double as MaxDiameter
from rows_ left join rack using (snapshot, tg_id) left join far using (snapshot, tg_id) left join anyok using (snapshot, tg_id) left join tp using (snapshot, tg_id) left join wt using (snapshot, tg_id) left join nd using (snapshot, tg_id) where might)"""


@query(f"with {_state_sql(TIMES)} select * replace (round(AvgQueueing, 2) as AvgQueueing) from groups_")
def t7_snapshot_taskgroups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_snapshots(spark, sf)[0], 2)


@query(
    f"""with {_state_sql(TIMES)}, js as (select distinct snapshot, job_id, status, c from rows_)
select js.snapshot, job_id as JobID, status as JobStatus, count(TaskGroupID) as InvolvedTGCnt, coalesce(sum(TotalTasks), 0)::bigint as TasksTotal, coalesce(sum(TasksStarted), 0)::bigint as TasksStarted, round(coalesce(sum(AvgQueueing * TotalTasks) / greatest(1, sum(TotalTasks)), 0), 2) as AvgTaskQueueing, round(coalesce(sum(Duration * TotalTasks) / greatest(1, sum(TotalTasks)), 0), 2) as AvgTaskDuration,
round(coalesce(sum(OriginalDuration * TotalTasks) / greatest(1, sum(TotalTasks)), 0), 2) as AvgTaskDurationOriginal, case when job_id % 5 = 0 then 'S' when list_contains(c, 2) then 'Y' else 'N' end as InpStatus from js left join groups_ on groups_.snapshot = js.snapshot and JobID = job_id group by js.snapshot, job_id, status, c"""
)
def t7_snapshot_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_snapshots(spark, sf)[1], 2)


NOW = 12 * DAY


@query(f"with {_state_sql((NOW,), ends=False)} select * exclude (snapshot) replace (round(AvgQueueing, 2) as AvgQueueing) from groups_")
def t5_taskgroup_locality(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the task-group table at one time, with where groups ran; jobs have no end here."""
    return rounded(_stats_with_locality(spark, sf), 2)


def _stats_with_locality(spark: SparkSession, sf: str) -> DataFrame:
    tgs, (machines, links) = materialize(_tgs(spark, sf), "groups"), fat_tree(spark, K)
    allocs = _table(spark, sf, "a").withColumn("preempted", F.coalesce(F.col("lost") <= NOW, F.lit(False)))
    ours = allocs.where((F.col("start_time") <= NOW) & ~F.col("preempted"))
    none = F.array().cast("array<int>")
    options = materialize(tenant.job_options_at(_job_events(spark, sf).where("event like 'flavor%'"), NOW), "options")
    own = tgs.join(options, "job_id", "left").withColumns({c: F.coalesce(c, none) for c in ("chosen", "excluded")})
    four = [F.col(c) for c in ("in_option", "not_in_option", "chosen", "excluded")]
    tasks = own.where(might_be_in_flavor(*four)).join(ours.groupBy("tg_id").agg(F.sum("num_tasks").alias("started")), "tg_id", "left")
    submits = tgs.select("job_id", F.col("submitted").alias("time"), F.lit("submit").alias("event"))
    status = tenant.job_status_at(submits, tasks.select("job_id", F.col("num_tasks").alias("total"), F.coalesce("started", F.lit(0)).alias("started")), NOW)
    present = ours.join(tgs.select("tg_id", "is_switch"), "tg_id").select("tg_id", "machine_id", "is_switch").distinct()
    counts = own.where(F.col("submitted") <= NOW).where(definitely_in_flavor(*four)).select(F.col("tg_id").alias("dst_tg"))
    where = snapshots.locality(present, tgs.where(F.col("submitted") <= NOW), _edges(tgs).join(counts, "dst_tg"), machines, links)
    return tenant.taskgroup_stats(allocs, tgs, status.join(options, "job_id", "left"), NOW, where)


@query(
    f"""with {_state_sql(TIMES)}, r as (select case when JobID % 2 = 0 then 'even' else 'odd' end as scheduler, snapshot as mu, InvolvedRacks as v from groups_ where JobStatus <> 'W' and TotalTasks = TasksStarted and TaskGroupType = 'I')
select scheduler, mu, count(v) as count, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, round(min(v), 4) as min, round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.75), 4) as p75, round(max(v), 4) as max from r group by 1, 2"""
)
def f6_locality_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """The frame of locality on racks where groups ran, from the event log; the snapshot is its x."""
    groups = _snapshots(spark, sf)[0]
    named = groups.withColumn("scheduler", F.when(F.col("JobID") % 2 == 0, "even").otherwise("odd")).withColumnRenamed("snapshot", "mu")
    return rounded(paper_frames.locality(named))
