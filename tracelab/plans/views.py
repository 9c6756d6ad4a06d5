"""The library's tables as views over the test tables: one SQL text for Spark and DuckDB, but for time arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {"DAYS": r"datediff(\1, date'1992-01-01')", "MS": r"timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', \1)"}
DUCK = {"DAYS": r"date_diff('day', timestamp '1992-01-01', \1)", "MS": r"((epoch_us(\1) - epoch_us(timestamp '2024-01-01')) // 1000)"}

VIEWS = {
    "task_rows": """
select concat('j', l_orderkey) as job, concat('T', l_linenumber) as name, case when l_orderkey % 3 = 0 then 'container' else 'DAG' end as type,
  case when l_suppkey % 7 = 0 then null else cast(l_quantity as bigint) end as instances,
  case when l_partkey % 11 = 0 then null else l_extendedprice / 12 end as cpu, l_discount * 1000 as mem,
  case when l_linenumber % 5 = 0 then 0 else cast(DAYS(l_shipdate) as bigint) * 86400 end as start_time,
  case when l_suppkey % 10 = 0 then 0 else cast(DAYS(l_shipdate) as bigint) * 86400 + cast(l_quantity as bigint) * 60 end as end_time,
  cast(DAYS(l_shipdate) as bigint) * 100000000000 + cast(l_partkey as bigint) * 100000 + l_suppkey as ord
from lineitem where l_linenumber is not null""",
    "task_names": """
select concat('j', l_orderkey) as job_name,
  concat(case l_suppkey % 3 when 0 then 'M' when 1 then 'R' else 'J' end, l_linenumber, case when l_linenumber > 1 then concat('_', l_linenumber - 1) else '' end, case when l_linenumber > 2 then concat('_', l_linenumber - 2) else '' end,
    case when l_partkey % 5 = 0 then '_Stg1' else '' end) as task_name,
  cast(l_quantity as bigint) as instance_num, l_extendedprice / 12 as plan_cpu, l_discount * 1000 as plan_mem, cast(0 as bigint) as start_time, cast(1 as bigint) as end_time,
  cast(DAYS(l_shipdate) as bigint) * 100000000000 + cast(l_partkey as bigint) * 100000 + l_suppkey as ord
from lineitem""",
    "status": """
select concat('m', user_id) as machine, event_type as status, cast(floor(MS(ts) / 60000) as bigint) as time, event_id as ord, value from events""",
    "container_rows": """
select concat('c', user_id % 40) as app_du, concat('k', user_id) as container_id, case event_type when 'signup' then 'allocated' when 'click' then 'started' when 'view' then 'unknow' else 'stopped' end as status,
  cast(floor(MS(ts) / 1000) as bigint) as time_stamp, cast(user_id % 9 as int) as cpu_request, value as mem_size, event_id as ord from events""",
    "runs": """
select 0 as experiment, cast(user_id % 6 as int) as run, case when user_id % 3 = 0 then 'hire' when user_id % 3 = 1 then 'k8-resubmit' else 'yarn-greedy' end as scheduler, case when user_id % 2 = 0 then 0.25 else 0.5 end as mu,
  MS(ts) as Time, event_type, value, event_id from events""",
    "counters": """
select experiment, run, scheduler, mu, Time,
  count(*) over w as CountJobs, count(case when event_type = 'click' then 1 end) over w as CountJobsWithInp, count(case when event_type = 'purchase' then 1 end) over w as TotalJobsFullyScheduledINP,
  count(case when event_type in ('purchase', 'signup') then 1 end) over w as TotalJobsFullyScheduled, count(case when event_type = 'error' then 1 end) over w as CountPreemptions, count(case when event_type = 'signup' then 1 end) over w as TimesSwitchFlavorTaken,
  count(case when event_type = 'view' and value > 50 then 1 end) over w as TimesServerFallbackResubmit, count(case when event_type = 'view' then 1 end) over w as ScheduledTasks, count(case when event_type = 'click' and value < 20 then 1 end) over w as PendingJobsFullyScheduled,
  cast(row_number() over w as bigint) as Allocations, cast(floor(Time / 100000) as bigint) as PastSystemMs
from runs window w as (partition by experiment, run order by Time, event_id rows between unbounded preceding and current row)""",
    "taskgroups": """
select 0 as experiment, cast(o_custkey % 6 as int) as run, case when o_custkey % 3 = 0 then 'hire' when o_custkey % 3 = 1 then 'k8-resubmit' else 'yarn-greedy' end as scheduler, case when o_custkey % 3 = 0 then 'hire' else 'other' end as strategy, case when o_custkey % 2 = 0 then 0.25 else 0.5 end as mu,
  o_custkey as JobID, o_orderkey as TaskGroupID, case o_orderstatus when 'F' then 'D' when 'O' then 'A' else 'W' end as JobStatus, case when o_orderpriority like '1%' then 'Y' when o_orderpriority like '2%' then 'N' else 'A' end as FlavorInp, 'Y' as ValidForJob,
  cast(DAYS(o_orderdate) as bigint) * 50000 as SubmissionTime, n as TotalTasks, case when o_orderkey % 9 = 0 then n - 1 else n end as TasksStarted, case when o_orderpriority like '1%' then 'I' else 'S' end as TaskGroupType, q / n as AvgQueueing,
  cast(DAYS(o_orderdate) as bigint) * 50000 + cast(q as bigint) * 100 + o_orderkey % 977 as PlacementLatency, cast(q as bigint) * 1000 as Duration, cast(q as bigint) * 1100 as OriginalDuration
from orders join (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by l_orderkey) x on l_orderkey = o_orderkey""",
    "solver": """
select 0 as experiment, cast(user_id % 6 as int) as run, event_type as Solver, MS(ts) as SimulationTime, event_id * 1000000 as StartTimeNanos, event_id * 1000000 + cast(floor(value * 1000) as bigint) as EndTimeNanos, user_id % 50 as ProducerCnt, user_id % 70 as NonProducerCnt, cast(floor(value * 1000) as bigint) as nanos
from events""",
    "allocs": """
select event_id as alloc_id, user_id % 97 as job_id, user_id as tg_id, user_id % 50 as machine_id, MS(ts) as start_time, MS(ts) + 1 + cast(floor(value * 1000) as bigint) as end_time, 1 + event_id % 3 as num_tasks, event_type as property, 1 + user_id % 4 as cpu, 1 + user_id % 2 as mem from events""",
}
VIEWS["alloc_events"] = """
select 2 * alloc_id as seq, start_time as time, 'claim' as event, alloc_id, job_id, tg_id, machine_id, num_tasks, property, cpu, mem from allocs
union all select 2 * alloc_id + 1 as seq, end_time as time, case when alloc_id % 10 = 0 then 'preempt' else 'release' end as event, alloc_id, job_id, tg_id, machine_id, num_tasks, property, cpu, mem from allocs"""
#: Allocations on switches, some of groups that ask for two properties, and those of the servers beside them.
VIEWS["switch_allocs"] = """
select event_id as alloc_id, user_id % 20 as machine_id, MS(ts) as start_time, MS(ts) + 1 + cast(floor(value * 500000) as bigint) as end_time, 1 + event_id % 2 as num_tasks,
  case when user_id % 5 = 0 then concat(2 + user_id % 8, ',', 2 + (user_id + 3) % 8) else concat(2 + user_id % 8, '') end as props, 1 + user_id % 4 as stages, 1 + user_id % 2 as tables, user_id % 3 as sram from events"""
VIEWS["switch_events"] = """
select 2 * alloc_id as seq, start_time as time, 'claim' as event, alloc_id, machine_id, num_tasks, props, stages, tables, sram from switch_allocs
union all select 2 * alloc_id + 1 as seq, end_time as time, case when alloc_id % 10 = 0 then 'preempt' else 'release' end as event, alloc_id, machine_id, num_tasks, props, stages, tables, sram from switch_allocs"""
VIEWS["job_times"] = """
select *, submitted + job_id % 977 * 1000 as chosen, submitted + job_id % 977 * 1000 + job_id % 1877 * 1000 as second_group, submitted + job_id % 977 * 1000 + job_id % 1877 * 1000 + job_id % 3001 * 1000 as ended
from (select o_orderkey as job_id, cast(o_custkey % 4 as int) as run, o_orderkey % 5 <> 0 as has_inp, case when o_orderkey % 5 <> 0 and o_custkey % 3 <> 0 then 2 else 1 end as bit, cast(DAYS(o_orderdate) as bigint) * 360000 + o_orderkey % 3571 * 1000 as submitted, o_orderstatus as fate from orders) x"""
VIEWS["job_log"] = """
select 8 * job_id + k as seq, time, event, job_id, run, has_inp, bit from (
select *, 0 as k, submitted as time, 'submit' as event from job_times
union all select *, 1 as k, chosen as time, 'flavor_chosen' as event from job_times
union all select *, 2 as k, chosen + 500 as time, 'flavor_removed' as event from job_times where job_id % 13 = 0
union all select *, 3 as k, chosen + 700 as time, 'resubmit' as event from job_times where job_id % 17 = 0
union all select *, 4 as k, second_group + 900 as time, 'withdraw' as event from job_times where job_id % 19 = 0
union all select *, 5 as k, second_group + 1000 as time, 'scheduled' as event from job_times where fate <> 'P' and job_id % 17 <> 0 and job_id % 19 <> 0
union all select *, 6 as k, ended + 1500 as time, 'scheduled' as event from job_times where fate <> 'P' and job_id % 23 = 0 and job_id % 17 <> 0 and job_id % 19 <> 0
union all select *, 7 as k, ended + 2000 as time, 'done' as event from job_times where fate = 'F' and job_id % 17 <> 0 and job_id % 19 <> 0) x"""
#: Two groups a job, the second submitted later.
VIEWS["job_groups"] = """
select run, job_id, 2 * job_id as tg_id, submitted, chosen + 600 as full_time from job_times
union all select run, job_id, 2 * job_id + 1 as tg_id, second_group + 800 as submitted, case when fate <> 'P' and job_id % 17 <> 0 then second_group + 1000 end as full_time from job_times"""

_NEEDS = {"counters": ["runs"], "alloc_events": ["allocs"], "switch_events": ["switch_allocs"], "job_log": ["job_times"], "job_groups": ["job_times"]}


def text(name: str, dialect: dict[str, str]) -> str:
    sql = VIEWS[name]
    for macro, form in dialect.items():
        sql = re.sub(rf"\b{macro}\((\w+)\)", form, sql)
    return sql


def with_views(*names: str, dialect: dict[str, str] = DUCK) -> str:
    """A WITH clause that defines the views."""
    all_ = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    return "with " + ",\n".join(f"{n} as ({text(n, dialect)})" for n in all_) + "\n"


TABLES = ("lineitem", "orders", "events", "customer", "supplier", "part", "nation", "region")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; tables are named by the path in the query, so that no session-wide name is taken."""
    sql = with_views(name, dialect=SPARK) + f"select * from {name}"
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))
