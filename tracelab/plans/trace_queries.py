"""Queries: trace cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.expressions import map_status, parse_task_name
from tracelab.operators import clean
from tracelab.plans.registry import query, rounded
from tracelab.plans.views import view


@query("select machine, status, case status when 'view' then true when 'error' then false end as available, time from status", "status")
def a1_map_status(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "status").select("machine", "status", map_status(F.col("status"), {"view": True, "error": False}).alias("available"), "time")


@query("select machine, arg_min(status, ord) as status, arg_min(time, ord) as time from status group by machine", "status")
def a2_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return clean.first_seen(view(spark, sf, "status"), ["machine"], ["status", "time"], "ord")


@query(
    """select machine, time, status, ord from (
select *, lag(status) over w as b, row_number() over w as k, count(*) over (partition by machine) as n from status window w as (partition by machine order by time, ord))
where k = 1 or k = n or b is distinct from status""",
    "status",
)
def a3_compress_status(spark: SparkSession, sf: str) -> DataFrame:
    return clean.compress_status(view(spark, sf, "status").select("machine", "time", "status", "ord"), ["machine"], "time", "status", "ord")


@query(
    """select machine, cpu, mem, case when cpu is null or cpu < 0 then 'cpu' when mem is null or mem < 0 then 'mem' when n < 1 then 'no event' end as reason from (
select machine, arg_min(case when ord % 13 = 0 then -1 else ord % 64 end, ord) as cpu, round(arg_min(value - 5, ord), 4) as mem, count(*) filter (where status in ('view', 'error')) as n from status group by machine)""",
    "status",
)
def a4_valid_machines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status").withColumn("cpu", F.when(F.col("ord") % 13 == 0, -1).otherwise(F.col("ord") % 64)).withColumn("mem", F.round(F.col("value") - 5, 4))
    static = clean.first_seen(rows, ["machine"], ["cpu", "mem"], "ord")
    events = rows.where("status in ('view', 'error')").groupBy("machine").agg(F.count("*").alias("n"))
    return static.join(events, "machine", "left").select("machine", "cpu", "mem", clean.machine_reason(F.col("cpu"), F.col("mem"), F.col("n")).alias("reason"))


@query(
    """select concat('container', app_du) as job, container_id as name, min(time_stamp) filter (where status in ('started', 'allocated')) as start_time, max(time_stamp) filter (where status = 'stopped') as end_time,
cast(arg_min(cpu_request, ord) as double) as cpu, round(arg_min(mem_size, ord), 4) as mem from container_rows group by app_du, container_id""",
    "container_rows",
)
def a5_container_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.container_intervals(view(spark, sf, "container_rows")).select("job", "name", "start_time", "end_time", "cpu", "mem"))


@query(
    """select job_name, task_name, regexp_extract(task_name, '^([A-Z])([0-9]+)', 0) as name, regexp_extract(task_name, '^([A-Z])', 1) as prefix,
coalesce(array_to_string(list_filter(string_split(regexp_extract(task_name, '^[A-Z][0-9]+((_[0-9]+)*)', 1), '_'), lambda x: x <> '')[-1:], ','), '') as deps from task_names""",
    "task_names",
)
def a6_parse_task_name(spark: SparkSession, sf: str) -> DataFrame:
    t = parse_task_name(F.col("task_name"))
    return view(spark, sf, "task_names").select("job_name", "task_name", t["name"].alias("name"), t["prefix"].alias("prefix"), F.array_join(t["deps"].cast("array<string>"), ",").alias("deps"))


MERGED = """merged as (select job_name as job, regexp_extract(task_name, '^[A-Z][0-9]+', 0) as name, regexp_extract(arg_min(task_name, ord), '^([A-Z])', 1) as prefix, arg_max(instance_num, ord) as instances, round(arg_max(plan_cpu, ord), 4) as cpu, round(arg_max(plan_mem, ord), 4) as mem,
list_filter(string_split(regexp_extract(arg_min(task_name, ord), '^[A-Z][0-9]+((_[0-9]+)*)', 1), '_'), lambda x: x <> '')[-1:] as deps from task_names group by 1, 2)"""


@query(f"with {MERGED} select job, name, instances, cpu, mem, array_to_string(deps, ',') as deps from merged", "task_names")
def a7_merge_task_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.merge_task_rows(view(spark, sf, "task_names")).select("job", "name", "instances", "cpu", "mem", F.array_join(F.col("deps").cast("array<string>"), ",").alias("deps")))


@query("select max(greatest(start_time, end_time)) as horizon from task_rows", "task_rows")
def a8_trace_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return clean.trace_horizon((view(spark, sf, "task_rows"), ["start_time", "end_time"]))


@query(
    f"""with {MERGED} select job, type, count(*) as groups from (select job, 'DAG' as type from merged union all select concat('container', app_du), 'container' from (select distinct app_du, container_id from container_rows)) group by job, type""",
    "task_names",
    "container_rows",
)
def a9_union_jobs(spark: SparkSession, sf: str) -> DataFrame:
    both = clean.union_jobs(clean.container_intervals(view(spark, sf, "container_rows")), clean.merge_task_rows(view(spark, sf, "task_names")))
    return both.groupBy("job", "type").agg(F.count("*").alias("groups"))


TIMED = """raw as (select job, name, type, arg_max(instances, ord) as instances, arg_max(cpu, ord) as cpu, arg_max(mem, ord) as mem, coalesce(arg_max(start_time, ord) filter (where start_time > 0), 0) as start_time,
coalesce(arg_max(end_time, ord) filter (where end_time > 0), 0) as end_time, min(ord) as ord from task_rows group by job, name, type),
horizon as (select max(greatest(start_time, end_time)) as h from task_rows),
timed as (select *, min(start_time) over (partition by job) as job_submit, start_time as tg_start, case when (case when end_time = 0 then h else end_time end) = start_time then start_time + 1 when end_time = 0 then h else end_time end as tg_end from raw, horizon),
judged as (select *, tg_end - tg_start as duration, case when instances is null then 'instances' when cpu is null or cpu <= 0 or cpu > 9600 then 'cpu' when mem is null or mem <= 0 or mem > 100 then 'mem' when tg_end - tg_start <= 0 then 'duration' end as reason from timed)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    last = lambda c, keep: F.max_by(F.when(keep, F.col(c)), F.when(keep, F.col("ord")))
    rows = view(spark, sf, "task_rows").groupBy("job", "name", "type")
    return rows.agg(
        *[last(c, F.col(c).isNotNull()).alias(c) for c in ("instances", "cpu", "mem")], *[F.coalesce(last(c, F.col(c) > 0), F.lit(0)).alias(c) for c in ("start_time", "end_time")], F.min("ord").alias("ord"), F.lit(None).cast("string").alias("prefix"), F.array().cast("array<int>").alias("deps")
    )


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    horizon = clean.trace_horizon((view(spark, sf, "task_rows"), ["start_time", "end_time"]))
    return clean.validate_tgs(clean.normalize_tg_times(_merged(spark, sf), horizon))


@query(f"with {TIMED} select job, name, job_submit, tg_start, tg_end, duration from judged", "task_rows")
def a10_normalize_tg_times(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("job", "name", "job_submit", "tg_start", "tg_end", "duration")


@query(f"with {TIMED} select job, name, reason from judged", "task_rows")
def a11_validate_tgs(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("job", "name", "reason")


@query(f"with {TIMED} select job, name, duration from judged where job not in (select job from judged where reason is not null)", "task_rows")
def a12_drop_jobs_with_bad_tg(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_jobs_with_bad_tg(_judged(spark, sf))[0].select("job", "name", "duration")


@query(f"with {MERGED} select w.job, s.name as src, w.name as dst from (select job, name, prefix, unnest(deps) as dep from merged) w join merged s on s.job = w.job and s.name = concat(w.prefix, w.dep)", "task_names")
def a13_build_dag(spark: SparkSession, sf: str) -> DataFrame:
    return clean.build_dag(clean.merge_task_rows(view(spark, sf, "task_names")))


@query(f"with {MERGED} select w.job, s.name as src, w.name as dst from (select job, name, unnest(deps) as dep from merged) w join merged s on s.job = w.job and substr(s.name, 2) = w.dep", "task_names")
def a13_build_dag_by_number(spark: SparkSession, sf: str) -> DataFrame:
    return clean.build_dag(clean.merge_task_rows(view(spark, sf, "task_names")), match="number")


@query(f"with {TIMED} select job, name, job_submit, tg_start, row_number() over (order by job_submit, job, tg_start, ord) - 1 as place from judged", "task_rows")
def a14_order_jobs(spark: SparkSession, sf: str) -> DataFrame:
    from tracelab.operators.workload import global_ordinal

    return global_ordinal(_judged(spark, sf).select("job", "name", "job_submit", "tg_start", "ord"), ["job_submit", "job", "tg_start", "ord"], "place").drop("ord")


@query(
    f"""with {TIMED}, jobs as (select type, job, bool_or(reason is not null) as failed, sum(duration) as total, count(*) as n, max(duration) as longest from judged group by type, job)
select type, count(*) filter (where not failed) as passed, count(*) filter (where failed) as rejected, round(sum(total) filter (where not failed) / sum(n) filter (where not failed), 4) as mean_duration, max(longest) filter (where not failed) as max_duration from jobs group by type""",
    "task_rows",
)
def a15_trace_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.trace_report(_judged(spark, sf)))


@query(f"with {TIMED} select job, type, tg_start as submit, duration, name as task_group, instances, round(mem, 4) as mem, round(cpu, 4) as cpu from judged where job not in (select job from judged where reason is not null)", "task_rows")
def s9_clean_jobs_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned jobs, written in order and read again."""
    from tracelab.sources.trace import read_clean_jobs, write_clean_jobs
    from tracelab.sources.scratch import scratch_path

    path = scratch_path(spark, "clean-jobs")
    good = clean.drop_jobs_with_bad_tg(_judged(spark, sf))[0]
    write_clean_jobs(clean.clean_jobs(good.withColumn("connections", F.lit(None).cast("string"))), path)
    return rounded(read_clean_jobs(spark, path).drop("connections"))
