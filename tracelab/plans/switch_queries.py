"""Queries: use of switches by property and dimension, from their event log to the files that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators import capacity, mappers, switches
from tracelab.plans.registry import query, rounded
from tracelab.plans.usage_queries import HOUR
from tracelab.plans.views import view

PROPERTIES, DIMS, CAPACITY, SERVERS, MOST = range(2, 10), 3, (400, 300, 200), (1000, 500), 3
SHARED = {p: (10 + p, 2 * p, 3) for p in PROPERTIES}
OWN = ("stages", "tables", "sram")


def _capacity(df: DataFrame, units: tuple[int, ...]) -> DataFrame:
    return df.select("machine_id").distinct().withColumn("capacity", F.array(*[F.lit(c).cast("bigint") for c in units]))


def _demands(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    events = view(spark, sf, "switch_events").withColumn("properties", F.split("props", ","))
    return switches.switch_demands(events, OWN, SHARED, mode)


def _load(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    capacity = _capacity(view(spark, sf, "switch_events"), CAPACITY)
    return switches.inc_load(_demands(spark, sf, mode), capacity, DIMS, HOUR, PROPERTIES)


def _demand_sql(mode: str) -> str:
    """dem: of each event the units by dimension that it takes; t: its properties, with whether it starts or ends them."""
    need = "case d when 0 then 10 + p::bigint when 1 then 2 * p::bigint else 3 end"
    whole = {"foreach": "step * num_tasks * need", "once": "step * case when turned then need else 0 end", "never": "0"}[mode]
    real = "0" if mode == "never" else "step * case when turned then need else 0 end"
    return f"""e as (select *, case when event = 'claim' then 1 else -1 end as step from switch_events),
x as (select *, unnest(split(props, ',')) as p from e), n as (select *, sum(step) over (partition by machine_id, p order by time, seq) as n from x),
t as (select *, (n = 1 and step = 1) or (n = 0 and step = -1) as turned from n),
y as (select *, {need} as need from t cross join (select unnest([0, 1, 2]) as d)),
dem as (select seq, any_value(time) as time, any_value(machine_id) as machine_id, any_value(step) as step, d, any_value(step * num_tasks * case d when 0 then stages when 1 then tables else sram end) + sum({whole}) as reserve, any_value(step * num_tasks * case d when 0 then stages when 1 then tables else sram end) + sum({real}) as real_ from y group by seq, d)"""


def _ticks(source: str) -> str:
    return f"ticks as (select unnest(range((select min(tick) from {source}), (select max(tick) from {source}) + 1, {HOUR})) as tick)"


TICK = f"cast(ceil(time / {HOUR}.0) as bigint) * {HOUR}"


def _load_sql(mode: str) -> str:
    """By overlap: spans in which a property is active on a switch, joined with the other events inside."""
    return f"""{_demand_sql(mode)},
use as (select *, sum(reserve) over (partition by machine_id, d order by time, seq) as after from dem),
spans as (select * from (select machine_id, p, time, seq, turned, step, lead(time) over w as t2, lead(seq) over w as s2 from t where turned window w as (partition by machine_id, p order by time, seq)) where step = 1),
deltas as (select p, d, {TICK.replace("time", "dem.time")} as tick, real_ as used, reserve as reserved, 0 as total, 0 as blocked from t join dem using (seq)
union all select p, d, {TICK.replace("time", "use.time")}, 0, 0, t.step * case d when 0 then {CAPACITY[0]} when 1 then {CAPACITY[1]} else {CAPACITY[2]} end, t.step * (after - case when t.step = 1 then reserve else 0 end) from t join use using (seq) where turned
union all select s.p, d, {TICK.replace("time", "dem.time")}, 0, 0, 0, reserve from dem join spans s on s.machine_id = dem.machine_id and (dem.time, dem.seq) > (s.time, s.seq) and (s.t2 is null or (dem.time, dem.seq) < (s.t2, s.s2)) where not exists (select 1 from t where t.seq = dem.seq and t.p = s.p)),
{_ticks("deltas")}, summed as (select p, d, tick, sum(used) as used, sum(reserved) as reserved, sum(total) as total, sum(blocked) as blocked from deltas group by all),
dense as (select p, d, tick, sum(coalesce(used, 0)) over w as used, sum(coalesce(reserved, 0)) over w as reserved, sum(coalesce(total, 0)) over w as total, sum(coalesce(blocked, 0)) over w as blocked from (select distinct p, d from deltas) cross join ticks left join summed using (p, d, tick) window w as (partition by p, d order by tick)),
load as (select p as property, d as dim, tick, used::bigint as used, reserved::bigint as reserved, total::bigint as total, blocked::bigint as blocked, round(case when total = 0 then 0 else used / total end, 6) as utilization, round(case when total = 0 then 0 else reserved / total end, 6) as reserved_share,
round(case when total = 0 then 0 else total / ((select count(distinct machine_id) from e) * case d when 0 then {CAPACITY[0]} when 1 then {CAPACITY[1]} else {CAPACITY[2]} end) end, 6) as total_share, round(case when total = 0 then 0 else blocked / total end, 6) as blocked_by_others from dense)"""


@query(f"with {_demand_sql('foreach')} select machine_id, time, seq, max(r) filter (where d = 0)::bigint as reserved0, max(u) filter (where d = 0)::bigint as used0, max(r) filter (where d = 2)::bigint as reserved2, max(u) filter (where d = 2)::bigint as used2 from (select machine_id, time, seq, d, sum(reserve) over w as r, sum(real_) over w as u from dem window w as (partition by machine_id, d order by time, seq)) group by machine_id, time, seq", "switch_events")
def c4_switch_usage(spark: SparkSession, sf: str) -> DataFrame:
    use = switches.switch_usage(_demands(spark, sf, "foreach"), DIMS)
    return use.select("machine_id", "time", "seq", *[F.col(c)[d].alias(f"{c}{d}") for c in ("reserved", "used") for d in (0, 2)])


@query(f"with {_load_sql('foreach')} select * from load", "switch_events")
def c6_inc_load_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_load(spark, sf, "foreach"), 6)


@query(f"with {_load_sql('once')} select * from load", "switch_events")
def c6_inc_load_once(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_load(spark, sf, "once"), 6)


def _wide(kinds: dict[str, str]) -> str:
    return ", ".join(f"coalesce(max({k}) filter (where property = '{p}' and dim = {d}), 0) as {name}_Prop{p}_Dim{d}" for p in PROPERTIES for d in range(DIMS) for k, name in kinds.items())


@query(f"with {_load_sql('foreach')} select tick as Time, {_wide(switches.KINDS)} from load group by tick", "switch_events")
def c7_load_file(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(switches.load_table(_load(spark, sf, "foreach"), PROPERTIES, DIMS), 6)


@query(f"with {_load_sql('foreach')} select property, dim, tick, round(case when total = 0 then 0 else (used + blocked) / total end, 6) as load, round(case when total = 0 then 0 else (reserved + blocked) / total end, 6) as reserved_load from load", "switch_events")
def c8_property_loads(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(switches.property_load(_load(spark, sf, "foreach")), 6)


def _cell_sql() -> str:
    server = "(case when event = 'claim' then 1 else -1 end) * num_tasks"
    parts = [f"select '{name}{d}' as series, {TICK} as tick, {value} as units from dem where d = {d}" for name, value in (("UtilizationSwitchesDim", "reserve"), ("ActualUtilizationSwitchesDim", "real_")) for d in range(DIMS)]
    parts += [f"select 'UtilizationSwitchINP', {TICK}, step from t where turned"] + [f"select 'UtilizationServersDim{d}', {TICK}, {server} * {c} from alloc_events" for d, c in enumerate(("cpu", "mem"))]
    # Events without a turned property still make a tick of the series.
    parts += [f"select 'UtilizationSwitchINP', {TICK}, 0 from e"]
    most = {f"{k}{d}": f"{CAPACITY[d]} * (select count(distinct machine_id) from e)" for k in ("UtilizationSwitchesDim", "ActualUtilizationSwitchesDim") for d in range(DIMS)}
    most |= {"UtilizationSwitchINP": f"{MOST} * (select count(distinct machine_id) from e)"} | {f"UtilizationServersDim{d}": f"{SERVERS[d]} * (select count(distinct machine_id) from allocs)" for d in range(2)}
    columns = ", ".join(f"round(max(u) filter (where series = '{k}') / ({v}), 6) as {k}" for k, v in most.items())
    return f"""with {_demand_sql("foreach")}, deltas as ({" union all ".join(parts)}), {_ticks("deltas")}, summed as (select series, tick, sum(units) as units from deltas group by all),
dense as (select series, tick, sum(coalesce(units, 0)) over (partition by series order by tick) as u from (select distinct series from deltas) cross join ticks left join summed using (series, tick))
select tick as Time, {columns} from dense group by tick"""


@query(_cell_sql(), "switch_events", "alloc_events")
def c5_cell_file(spark: SparkSession, sf: str) -> DataFrame:
    events, servers = view(spark, sf, "switch_events"), view(spark, sf, "alloc_events")
    table = switches.cell_table(servers, ["cpu", "mem"], _capacity(servers, SERVERS), _demands(spark, sf, "foreach"), _capacity(events, CAPACITY), DIMS, HOUR, MOST)
    return rounded(table, 6)


def _summary_sql() -> str:
    at = lambda kind, p, d: f"{kind}Switch_Prop{p}_Dim{d}"
    load = lambda p, d: f"({at('Utilization', p, d)} + {at('BlockedByOthers', p, d)})"
    columns = [f"round(({' + '.join(load(p, d) for d in range(DIMS))}) / {DIMS}, 7) as Prop{p}_Load" for p in PROPERTIES] + [f"case when greatest({', '.join(at('Total', p, d) for d in range(DIMS))}) > 0 then 1.0 else 0.0 end::double as Prop{p}_Active" for p in PROPERTIES]
    for d in range(DIMS):
        total = " + ".join(at("Total", p, d) for p in PROPERTIES)
        columns.append(f"round(({' + '.join(f'(1 - {load(p, d)}) * {at("Total", p, d)}' for p in PROPERTIES)}) / ({total} + 0.01), 7) as Unused_Dim{d}")
    return f"with {_load_sql('foreach')}, wide as (select tick as Time, {_wide(switches.KINDS)} from load group by tick) select Time, {', '.join(columns)} from wide"


@query(_summary_sql(), "switch_events")
def e14_inc_load_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """From the switches' event log by way of the load file's columns."""
    wide = rounded(switches.load_table(_load(spark, sf, "foreach"), PROPERTIES, DIMS), 6)
    out = mappers.inc_load_summary(wide, dims=DIMS)
    return rounded(out.select("Time", *[f"Prop{p}_{k}" for k in ("Load", "Active") for p in PROPERTIES], *[f"Unused_Dim{d}" for d in range(DIMS)]), 7)


NOW = 1_500_000_000
#: Groups of servers (even ids) and of switches (odd ones), and the states of machines at a time.
FIT = f"""live as (select machine_id, props, num_tasks, stages, tables, sram, alloc_id from switch_allocs where start_time <= {NOW} and end_time > {NOW}),
act as (select machine_id, list(distinct p) as active from (select machine_id, unnest(split(props, ',')) as p from live) group by 1),
need as (select machine_id, sum(num_tasks * (stages + (select sum(10 + p::bigint) from unnest(split(props, ',')) as t(p)))) as u0, sum(num_tasks * (tables + (select sum(2 * p::bigint) from unnest(split(props, ',')) as t(p)))) as u1, sum(num_tasks * (sram + 3 * len(split(props, ',')))) as u2 from live group by 1),
m as (select machine_id, true as sw, {CAPACITY[0]} - coalesce(u0, 0) as f0, {CAPACITY[1]} - coalesce(u1, 0) as f1, {CAPACITY[2]} - coalesce(u2, 0) as f2, coalesce(active, []) as active from (select distinct machine_id from switch_allocs) left join need using (machine_id) left join act using (machine_id)
union all select machine_id, false, 1000 - sum(case when start_time <= {NOW} and end_time > {NOW} then num_tasks * cpu else 0 end), 500 - sum(case when start_time <= {NOW} and end_time > {NOW} then num_tasks * mem else 0 end), 0, [] from allocs group by 1),
g as (select distinct user_id * 2 as tg_id, false as sw, (1 + user_id % 4) * 37 as d0, (1 + user_id % 2) * 41 as d1, 0 as d2, [] as props, user_id % 3 = 0 as co, user_id % 6 as waiting from events
union all select distinct user_id * 2 + 1, true, 20 * (1 + user_id % 4), 15 * (1 + user_id % 2), 10 * (user_id % 3), split(case when user_id % 5 = 0 then concat(2 + user_id % 8, ',', 2 + (user_id + 3) % 8) else concat(2 + user_id % 8, '') end, ','), user_id % 7 = 0, user_id % 6 from events),
held as (select distinct tg_id * 2 as tg_id, machine_id from allocs where start_time <= {NOW} and end_time > {NOW} union select distinct user_id * 2 + 1, user_id % 20 from events join live on alloc_id = event_id),
w as (select g.*, m.machine_id, f0, f1, f2, active, list_filter(props, lambda p: not list_contains(active, p)) as missing, d0 + coalesce(list_sum([10 + p::bigint for p in props if not list_contains(active, p)]), 0) as e0, d1 + coalesce(list_sum([2 * p::bigint for p in props if not list_contains(active, p)]), 0) as e1, d2 + 3 * len([p for p in props if not list_contains(active, p)]) as e2 from g join m using (sw)),
k as (select *, case when sw and (list_contains(props, concat(2 + machine_id % 8, '')) or (len(missing) > 0 and len(active) + len(missing) > {MOST + 2})) then 0 else greatest(0, least(f0 // e0, f1 // e1, case when e2 > 0 then f2 // e2 else 2147483647 end)) end as fit from w)"""


def _groups_and_machines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    now = (F.col("start_time") <= NOW) & (F.col("end_time") > NOW)
    none = F.array().cast("array<string>")
    events = view(spark, sf, "switch_events")
    demands = _demands(spark, sf, "foreach").where(F.col("time") <= NOW)
    used = switches.switch_usage(demands, DIMS).groupBy("machine_id").agg(F.max_by("reserved", F.struct("time", "seq")).alias("used"))
    live = view(spark, sf, "switch_allocs").where(now)
    active = live.select("machine_id", F.explode(F.split("props", ",")).alias("p")).groupBy("machine_id").agg(F.collect_set("p").alias("active"))
    most = F.array(*[F.lit(c).cast("bigint") for c in CAPACITY])
    kinds = F.array(*[F.lit(str(p)) for p in PROPERTIES])
    free = F.zip_with(most, F.coalesce("used", F.transform(most, lambda x: x * 0)), lambda c, u: c - u)
    machines = events.select("machine_id").distinct().join(used, "machine_id", "left").join(active, "machine_id", "left")
    own = F.array((2 + F.col("machine_id") % 8).cast("string"))
    machines = machines.select("machine_id", F.lit(True).alias("is_switch"), free.alias("free"), F.array_except(kinds, own).alias("supported"), F.sort_array(F.coalesce("active", none)).alias("active"))
    rows = view(spark, sf, "allocs")
    busy = lambda c: F.sum(F.when(now, F.col("num_tasks") * F.col(c)).otherwise(0))
    servers = rows.groupBy("machine_id").agg((1000 - busy("cpu")).alias("f0"), (500 - busy("mem")).alias("f1"))
    machines = machines.unionByName(servers.select("machine_id", F.lit(False).alias("is_switch"), F.array("f0", "f1").alias("free"), none.alias("supported"), none.alias("active")))
    u, users = F.col("tg_id"), rows.select("tg_id").distinct()
    props = F.when(u % 5 == 0, F.array((2 + u % 8).cast("string"), (2 + (u + 3) % 8).cast("string"))).otherwise(F.array((2 + u % 8).cast("string")))
    on_servers = users.select((u * 2).alias("tg_id"), F.array((1 + u % 4) * 37, (1 + u % 2) * 41).alias("demand"), F.lit(False).alias("is_switch"), none.alias("properties"), (u % 3 == 0).alias("co_locate"), (u % 6).alias("not_started"))
    on_switches = users.select((u * 2 + 1).alias("tg_id"), F.array(20 * (1 + u % 4), 15 * (1 + u % 2), 10 * (u % 3)).alias("demand"), F.lit(True).alias("is_switch"), props.alias("properties"), (u % 7 == 0).alias("co_locate"), (u % 6).alias("not_started"))
    held = rows.where(now).select((u * 2).alias("tg_id"), "machine_id").unionByName(rows.join(live.select("alloc_id"), "alloc_id", "left_semi").select((u * 2 + 1).alias("tg_id"), (u % 20).alias("machine_id")))
    return on_servers.unionByName(on_switches), machines, held


@query(
    f"with {FIT} select tg_id, cast(count(*) filter (where least(fit, waiting) > 0 and (co or not exists (select 1 from held where held.tg_id = k.tg_id and held.machine_id = k.machine_id))) as bigint) as machines, cast(sum(case when co then least(fit, waiting) when exists (select 1 from held where held.tg_id = k.tg_id and held.machine_id = k.machine_id) then 0 else least(fit, waiting, 1) end) as bigint) as tasks from k group by tg_id",
    "switch_allocs", "allocs",
)
def c12_capacity_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of servers and switches, co-located or spread over machines, which then take no machine that they hold."""
    tgs, machines, held = _groups_and_machines(spark, sf)
    return capacity.capacity_fit(tgs, machines, MOST + 2, held, SHARED, "once")


@query(f"with {FIT} select tg_id, cast(count(*) filter (where fit > 0) as bigint) as machines, cast(sum(case when co then fit else least(fit, 1) end) as bigint) as tasks from k group by tg_id", "switch_allocs", "allocs")
def c12_capacity_of_all_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The same, however many tasks run or wait."""
    tgs, machines, held = _groups_and_machines(spark, sf)
    return capacity.capacity_fit(tgs, machines, MOST + 2, held, SHARED, "once", ignore_running=True)
