"""Queries: use of resources from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.expressions import load_level
from tracelab.operators import capacity, switches, usage
from tracelab.plans.registry import query, rounded
from tracelab.plans.views import view

HOUR = 3_600_000
SIGN = "case when event = 'claim' then 1 else -1 end"


def _capacity(spark: SparkSession, sf: str) -> DataFrame:
    machines = view(spark, sf, "allocs").select("machine_id").distinct()
    return machines.select("machine_id", F.explode(F.array(F.struct(F.lit(0).alias("dim"), F.lit(1000).alias("capacity")), F.struct(F.lit(1).alias("dim"), F.lit(500).alias("capacity")))).alias("x")).select("machine_id", "x.dim", "x.capacity")


@query("select alloc_id, case when num_tasks <= 1 then 'no tasks' else 'ended before its claim' end as rule from (select alloc_id, num_tasks - 1 as t, num_tasks, start_time, end_time from allocs) where t <= 0 or end_time < start_time", "allocs")
def c1_check_event_log(spark: SparkSession, sf: str) -> DataFrame:
    return usage.check_event_log(view(spark, sf, "alloc_events").withColumn("num_tasks", F.col("num_tasks") - 1))


@query(
    f"""with d as (select seq, time, machine_id, 0 as dim, ({SIGN}) * num_tasks * cpu as delta, 1000 as cap from alloc_events union all select seq, time, machine_id, 1, ({SIGN}) * num_tasks * mem, 500 from alloc_events)
select seq, time, machine_id, dim, cast(sum(delta) over w as bigint) as used, cast(cap - sum(delta) over w as bigint) as free from d window w as (partition by machine_id, dim order by time, seq)""",
    "alloc_events",
)
def c2_server_usage(spark: SparkSession, sf: str) -> DataFrame:
    return usage.server_usage(view(spark, sf, "alloc_events"), ["cpu", "mem"], _capacity(spark, sf))


TOGGLES = f"""steps as (select *, {SIGN} as step, sum({SIGN}) over (partition by machine_id, property order by time, seq) as n from alloc_events),
toggles as (select seq, time, machine_id, property, step > 0 as active from steps where (n = 1 and step = 1) or (n = 0 and step = -1))"""


@query(f"with {TOGGLES} select * from toggles", "alloc_events")
def c3_active_properties(spark: SparkSession, sf: str) -> DataFrame:
    return usage.active_properties(view(spark, sf, "alloc_events"))


def _shared(mode: str) -> str:
    toggle = "case when n = 1 and step = 1 then 1 when n = 0 and step = -1 then -1 else 0 end"
    once = "0" if mode == "never" else f"({toggle}) * length(property)"
    reserve = "step * num_tasks * length(property)" if mode == "foreach" else once
    return f"with {TOGGLES} select seq, time, machine_id, cast(sum(step * num_tasks * cpu + {reserve}) over w as bigint) as reserved, cast(sum(step * num_tasks * cpu + {once}) over w as bigint) as used from steps window w as (partition by machine_id order by time, seq)"


def _shared_usage(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    demand = view(spark, sf, "allocs").select("property", F.length("property").alias("demand")).distinct()
    return usage.shared_demand_usage(view(spark, sf, "alloc_events"), "cpu", demand, mode)


@query(_shared("once"), "alloc_events")
def c4_shared_demand_once(spark: SparkSession, sf: str) -> DataFrame:
    return _shared_usage(spark, sf, "once")


@query(_shared("foreach"), "alloc_events")
def c4_shared_demand_foreach(spark: SparkSession, sf: str) -> DataFrame:
    return _shared_usage(spark, sf, "foreach")


@query(_shared("never"), "alloc_events")
def c4_shared_demand_never(spark: SparkSession, sf: str) -> DataFrame:
    return _shared_usage(spark, sf, "deactivated")


KINDS = ("click", "error", "purchase", "signup", "view")
TICK = f"cast(ceil(time / {HOUR}.0) as bigint) * {HOUR}"
TICKS = f"ticks as (select unnest(range((select min({TICK}) from alloc_events), (select max({TICK}) from alloc_events) + 1, {HOUR})) as tick)"


@query(
    f"""with d as (select 0 as dim, {TICK} as tick, ({SIGN}) * num_tasks * cpu as delta from alloc_events union all select 1, {TICK}, ({SIGN}) * num_tasks * mem from alloc_events), {TICKS},
total as (select count(distinct machine_id) as n from allocs), s as (select dim, tick, sum(delta) as delta from d group by 1, 2), g as (select dim, tick from (select unnest([0, 1]) as dim) cross join ticks)
select dim, tick, cast(sum(coalesce(delta, 0)) over (partition by dim order by tick) as bigint) as used, round(sum(coalesce(delta, 0)) over (partition by dim order by tick) / (n * case dim when 0 then 1000 else 500 end), 6) as utilization from g left join s using (dim, tick), total""",
    "alloc_events",
)
def c5_cell_utilization(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.cell_utilization(view(spark, sf, "alloc_events"), ["cpu", "mem"], _capacity(spark, sf), HOUR), 6)


LOAD = f"""{TOGGLES}, moves as (select seq, time, machine_id, property, ({SIGN}) * num_tasks * cpu as d from alloc_events),
spans as (select * from (select *, lead(time) over w as t2, lead(seq) over w as s2 from toggles window w as (partition by machine_id, property order by time, seq)) where active),
deltas as (select property, {TICK} as tick, d as used, 0 as total, 0 as blocked from moves
union all select s.property, cast(ceil(m.time / {HOUR}.0) as bigint) * {HOUR}, 0, 0, m.d from moves m join spans s on s.machine_id = m.machine_id and s.property <> m.property and (m.time, m.seq) > (s.time, s.seq) and (s.t2 is null or (m.time, m.seq) < (s.t2, s.s2))
union all select t.property, cast(ceil(t.time / {HOUR}.0) as bigint) * {HOUR}, 0, case when t.active then 1000 else -1000 end, (case when t.active then 1 else -1 end) * (x.all_use - x.own_use) from toggles t join (select *, sum(d) over (partition by machine_id order by time, seq) as all_use, sum(d) over (partition by machine_id, property order by time, seq) as own_use from moves) x using (seq)),
{TICKS}, summed as (select property, tick, sum(used) as used, sum(total) as total, sum(blocked) as blocked from deltas group by 1, 2),
dense as (select property, tick, sum(coalesce(used, 0)) over w as used, sum(coalesce(total, 0)) over w as total, sum(coalesce(blocked, 0)) over w as blocked from (select distinct property from deltas) cross join ticks left join summed using (property, tick) window w as (partition by property order by tick))"""


def _load(spark: SparkSession, sf: str) -> DataFrame:
    """One dimension, without needs of the properties' own."""
    units = _capacity(spark, sf).where("dim = 0").select("machine_id", F.array("capacity").alias("capacity"))
    demands = switches.switch_demands(view(spark, sf, "alloc_events").withColumn("properties", F.array("property")), ["cpu"])
    return switches.inc_load(demands, units, 1, HOUR, KINDS)


@query(f"with {LOAD} select property, tick, cast(used as bigint) as used, cast(total as bigint) as total, cast(blocked as bigint) as blocked, round(coalesce(used / nullif(total, 0), 0), 6) as utilization, round(coalesce(blocked / nullif(total, 0), 0), 6) as blocked_by_others from dense", "alloc_events")
def c6_inc_load(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_load(spark, sf).select("property", "tick", "used", "total", "blocked", "utilization", "blocked_by_others"), 6)


@query(f"with {LOAD} select tick, max(round(coalesce(used / nullif(total, 0), 0), 6)) filter (where property = 'click') as click_utilization, max(round(coalesce(used / nullif(total, 0), 0), 6)) filter (where property = 'error') as error_utilization from dense group by tick", "alloc_events")
def c7_inc_load_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = switches.load_table(_load(spark, sf), ["click", "error"], 1)
    return rounded(wide.select(F.col("Time").alias("tick"), *[F.col(f"UtilizationSwitch_Prop{p}_Dim0").alias(f"{p}_utilization") for p in ("click", "error")]), 6)


@query(f"with {LOAD} select property, tick, round(coalesce((used + blocked) / nullif(total, 0), 0), 6) as load from dense", "alloc_events")
def c8_property_load(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(switches.property_load(_load(spark, sf)).select("property", "tick", "load"), 6)


@query(
    f"""with {TOGGLES}, a as (select *, sum(case when active then 1 else -1 end) over (partition by machine_id order by time, seq) as n from toggles), s as (select {TICK} as tick, sum(case when active then 1 else -1 end) as d, sum(case when active and n = 1 then 1 when not active and n = 0 then -1 else 0 end) as u from a group by 1), t as (select unnest(range((select min(tick) from s), (select max(tick) from s) + 1, {HOUR})) as tick)
select tick, cast(sum(coalesce(d, 0)) over (order by tick) as bigint) as active, cast(sum(coalesce(u, 0)) over (order by tick) as bigint) as in_use, round(sum(coalesce(d, 0)) over (order by tick) / 50.0, 6) as mean_active, round(sum(coalesce(d, 0)) over (order by tick) / 150.0, 6) as share from t left join s using (tick)""",
    "alloc_events",
)
def c9_active_inc_load(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.active_inc_load(usage.active_properties(view(spark, sf, "alloc_events")), 50, 3, HOUR), 6)


@query(
    f"""with {TOGGLES}, a as (select *, case when active then 1 else -1 end as st, sum(case when active then 1 else -1 end) over (partition by machine_id order by time, seq) as n from toggles),
e as (select a.*, p, sum(case when property = p then st else 0 end) over (partition by machine_id, p order by time, seq) > 0 or n >= 3 as taken from a cross join (select unnest([{", ".join(f"'{k}'" for k in KINDS)}]) as p)),
m as (select p as property, {TICK} as tick, cast(taken as int) - coalesce(lag(cast(taken as int)) over (partition by machine_id, p order by time, seq), 0) as d from e),
s as (select property, tick, sum(d) as d from m where d <> 0 group by 1, 2), t as (select unnest(range((select min(tick) from s), (select max(tick) from s) + 1, {HOUR})) as tick)
select property, tick, cast(sum(coalesce(d, 0)) over (partition by property order by tick) as bigint) as blocked, round(sum(coalesce(d, 0)) over (partition by property order by tick) / 50.0, 6) as share from (select distinct property from s) cross join t left join s using (property, tick)""",
    "alloc_events",
)
def c10_property_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.property_occupancy(usage.active_properties(view(spark, sf, "alloc_events")), KINDS, 50, 3, HOUR), 6)


FREE = f"free as (select machine_id, cast(1000 - sum(({SIGN}) * num_tasks * cpu) as bigint) as f0, cast(500 - sum(({SIGN}) * num_tasks * mem) as bigint) as f1 from alloc_events where time <= 1500000000 group by machine_id)"


@query(f"with {FREE} select machine_id, cast(floor(100 * (1000 - f0) / 1000) as bigint) as load0, cast(floor(100 * (500 - f1) / 500) as bigint) as load1 from free", "alloc_events")
def c11_machine_load(spark: SparkSession, sf: str) -> DataFrame:
    free = _free(spark, sf)
    return free.select("machine_id", load_level(F.col("f0"), F.lit(1000), 100).alias("load0"), load_level(F.col("f1"), F.lit(500), 100).alias("load1"))


def _free(spark: SparkSession, sf: str) -> DataFrame:
    now = view(spark, sf, "alloc_events").where("time <= 1500000000")
    step = usage.sign() * F.col("num_tasks")
    return now.groupBy("machine_id").agg((1000 - F.sum(step * F.col("cpu"))).alias("f0"), (500 - F.sum(step * F.col("mem"))).alias("f1"))


@query(
    f"""with {FREE}, tgs as (select distinct tg_id, cpu * 37 as c, mem * 41 as m from allocs)
select tg_id, cast(count(*) filter (where least(f0 // c, f1 // m) > 0) as bigint) as machines, cast(sum(greatest(0, least(f0 // c, f1 // m))) as bigint) as tasks from tgs cross join free group by tg_id""",
    "alloc_events",
)
def c12_capacity_fit(spark: SparkSession, sf: str) -> DataFrame:
    tgs = view(spark, sf, "allocs").select("tg_id", F.array(F.col("cpu") * 37, F.col("mem") * 41).alias("demand"), F.lit(False).alias("is_switch"), F.array().cast("array<string>").alias("properties")).distinct()
    none = F.array().cast("array<string>")
    machines = _free(spark, sf).select("machine_id", F.lit(False).alias("is_switch"), F.array("f0", "f1").alias("free"), none.alias("supported"), none.alias("active"))
    return capacity.capacity_fit(tgs, machines)


@query(
    f"""with {FREE}, m as (select distinct machine_id from allocs)
select 0 as dim, cast(count(*) * 1000 as bigint) as capacity, cast(sum(coalesce(f0, 1000)) as bigint) as free, bool_and(coalesce(f0, 1000) = 1000) as all_free from m left join free using (machine_id)
union all select 1, cast(count(*) * 500 as bigint), cast(sum(coalesce(f1, 500)) as bigint), bool_and(coalesce(f1, 500) = 500) from m left join free using (machine_id)""",
    "alloc_events",
)
def c13_total_capacity(spark: SparkSession, sf: str) -> DataFrame:
    free = _free(spark, sf).select("machine_id", F.posexplode(F.array("f0", "f1")).alias("dim", "free"))
    return usage.total_capacity(_capacity(spark, sf), free)
