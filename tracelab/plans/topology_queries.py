"""Queries: locality of the event log's task groups in a fat tree of 16 servers, whose machines they are mapped to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators import topology
from tracelab.plans.registry import query
from tracelab.plans.views import view
from tracelab.sources.topology import fat_tree

K = 4
#: Rack switches are 12 to 19, aggregation 4 to 11, core 0 to 3; server s is in rack 12 + s // 2.
PLACED = """placed as (select distinct job_id as tg_id, case when property = 'error' then machine_id % 20 else machine_id % 16 end as machine_id, property = 'error' as is_switch from allocs),
places_ as (select distinct tg_id, is_switch, case when is_switch then machine_id else 12 + machine_id // 2 end as switch from placed)"""
#: Links of the tree, both ways, and hop counts by repeated joins.
HOPS = """links as (select 12 + x // 2 as a, 4 + (x // 2) // 2 * 2 + x % 2 as b from (select unnest(range(16)) as x) union all select 4 + x // 2, (x // 2) % 2 * 2 + x % 2 from (select unnest(range(16)) as x)),
two as (select a, b from links union select b, a from links),
h1 as (select a, b, 1 as hops from two), h2 as (select distinct x.a, y.b, 2 as hops from two x join two y on x.b = y.a), h3 as (select distinct x.a, y.b, 3 as hops from h2 x join two y on x.b = y.a), h4 as (select distinct x.a, y.b, 4 as hops from h3 x join two y on x.b = y.a),
hops as (select a, b, min(hops) as hops from (select s as a, s as b, 0 as hops from (select unnest(range(20)) as s) union all select * from h1 union all select * from h2 union all select * from h3 union all select * from h4) group by 1, 2)"""
EDGES = "edges as (select distinct job_id as src_tg, (job_id + 1) % 97 as dst_tg from allocs)"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    switch = F.col("property") == "error"
    return view(spark, sf, "allocs").select(F.col("job_id").alias("tg_id"), F.when(switch, F.col("machine_id") % 20).otherwise(F.col("machine_id") % 16).alias("machine_id"), switch.alias("is_switch")).distinct()


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "allocs").select(F.col("job_id").alias("src_tg"), ((F.col("job_id") + 1) % 97).alias("dst_tg")).distinct()


@query(f"with {PLACED} select tg_id, machine_id, 12 + machine_id // 2 as tor from placed where not is_switch", "allocs")
def l1_server_tor(spark: SparkSession, sf: str) -> DataFrame:
    tor = topology.server_tor(fat_tree(spark, K)[1])
    return _placed(spark, sf).where("not is_switch").join(tor, F.col("machine_id") == F.col("server")).select("tg_id", "machine_id", "tor")


@query(f"with {PLACED}, {HOPS} select distinct tg_id, machine_id as switch, b as parent from placed join links on machine_id = a where is_switch", "allocs")
def l2_switch_parents(spark: SparkSession, sf: str) -> DataFrame:
    parents = topology.switch_parents(fat_tree(spark, K)[1])
    return _placed(spark, sf).where("is_switch").join(parents, F.col("machine_id") == F.col("switch")).select("tg_id", "switch", "parent")


@query(
    f"""with {PLACED}, s as (select unnest(range(16)) as server), reach as (select t as switch, server from (select unnest(range(20)) as t) cross join s where t < 4 or (t between 4 and 11 and (t - 4) // 2 = server // 4) or t = 12 + server // 2)
select tg_id, count(distinct server) as servers from placed join reach on switch = machine_id where is_switch group by tg_id""",
    "allocs",
)
def l3_reachable_servers(spark: SparkSession, sf: str) -> DataFrame:
    reach = topology.reachable_servers(fat_tree(spark, K)[1])
    return _placed(spark, sf).where("is_switch").join(reach, F.col("machine_id") == F.col("switch")).groupBy("tg_id").agg(F.count_distinct("server").alias("servers"))


@query(f"with {PLACED}, {HOPS} select x.tg_id, x.machine_id as a, y.machine_id as b, case when x.machine_id = y.machine_id then 0 else hops + 2 end as hops from placed x join placed y on y.tg_id = (x.tg_id + 1) % 97 join hops h on h.a = 12 + x.machine_id // 2 and h.b = 12 + y.machine_id // 2 where not x.is_switch and not y.is_switch", "allocs")
def l4_server_distance(spark: SparkSession, sf: str) -> DataFrame:
    links = fat_tree(spark, K)[1]
    servers = _placed(spark, sf).where("not is_switch")
    pairs = servers.select("tg_id", F.col("machine_id").alias("a")).join(servers.select(F.col("tg_id").alias("t"), F.col("machine_id").alias("b")), F.col("t") == (F.col("tg_id") + 1) % 97).select("tg_id", "a", "b")
    hops = topology.server_distance(pairs.select("a", "b").distinct(), links)
    return pairs.join(hops, ["a", "b"])


@query(f"with {PLACED} select tg_id, count(distinct switch) as racks from places_ group by tg_id", "allocs")
def l5_involved_racks(spark: SparkSession, sf: str) -> DataFrame:
    return topology.involved_racks(_placed(spark, sf), fat_tree(spark, K)[1])


@query(f"with {PLACED}, {EDGES} select distinct src_tg as tg_id, machine_id, is_switch from edges join placed on tg_id = dst_tg", "allocs")
def l6_connected_machines(spark: SparkSession, sf: str) -> DataFrame:
    return topology.connected_machines(_placed(spark, sf), _edges(spark, sf))


@query(
    f"""with {PLACED}, {EDGES}, {HOPS}, m as (select o.tg_id, max(case when o.switch <> f.switch then hops + case when f.is_switch then 0 else 1 end else 0 end) as m from places_ o join edges on src_tg = o.tg_id join places_ f on f.tg_id = dst_tg join hops h on h.a = o.switch and h.b = f.switch group by o.tg_id),
k as (select tg_id, max(case when is_switch then 0 else 1 end) as first_ from placed group by 1)
select tg_id, case when tg_id in (select src_tg from edges) then coalesce(m, 0) + first_ else -1 end as max_diameter from k left join m using (tg_id)""",
    "allocs",
)
def l7_max_diameter(spark: SparkSession, sf: str) -> DataFrame:
    links = fat_tree(spark, K)[1]
    return topology.max_diameter(_placed(spark, sf), _edges(spark, sf), links)


def l8_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Small groups: a job's machines within an hour."""
    rows = view(spark, sf, "allocs").withColumn("tg_id", F.concat_ws("-", "job_id", F.floor(F.col("start_time") / 3_600_000)))
    switch = F.col("alloc_id") % 2 == 0
    return rows.select("tg_id", F.when(switch, F.col("machine_id") % 20).otherwise(F.col("machine_id") % 16).alias("machine_id"), switch.alias("is_switch")).distinct()


@query(
    f"""with {HOPS}, g as (select distinct concat_ws('-', job_id, cast(floor(start_time / 3600000) as bigint)) as tg_id, case when alloc_id % 2 = 0 then machine_id % 20 else machine_id % 16 end as machine_id, alloc_id % 2 = 0 as is_switch from allocs),
s as (select tg_id, machine_id as server from g where not is_switch), lv as (select t as switch, case when t < 4 then 2 when t < 12 then 1 else 0 end as level from (select unnest(range(20)) as t)),
reach as (select t as switch, v as server from (select unnest(range(20)) as t) cross join (select unnest(range(16)) as v) where t < 4 or (t between 4 and 11 and (t - 4) // 2 = v // 4) or t = 12 + v // 2),
o as (select tg_id, switch, level, max(level) over (partition by tg_id) as top from g join lv on switch = machine_id where is_switch),
u1 as (select distinct tg_id, b as switch from o join links on a = switch where level = top), u2 as (select distinct tg_id, b as switch from u1 join links on a = switch),
k as (select tg_id, switch, 0 as lift from o union all select tg_id, switch, 1 from u1 union all select tg_id, switch, 2 from u2),
c as (select tg_id, server, min(lift) as lift from k join reach using (switch) join s using (tg_id, server) group by 1, 2), n as (select tg_id, count(*) as met, max(lift) as need from c group by 1), w as (select tg_id, count(*) as wanted from s group by 1), tp as (select distinct tg_id, top from o)
select distinct g.tg_id, coalesce(case when top is null or wanted is null then -1 when met = wanted then need else 2 - top + 2 end, -1) as detour from g left join tp using (tg_id) left join w using (tg_id) left join n using (tg_id)""",
    "allocs",
)
def l8_detour_levels(spark: SparkSession, sf: str) -> DataFrame:
    machines, links = fat_tree(spark, K)
    return topology.detour_levels(l8_groups(spark, sf), machines, links)


@query("select distinct machine_id, true as is_switch, 'link to nowhere' as rule from (select 20 + user_id as machine_id from events)")
def l9_check_topology(spark: SparkSession, sf: str) -> DataFrame:
    """The tree with links to switches that it lacks, one for each user."""
    machines, links = fat_tree(spark, K)
    events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") + 20).alias("dst")).distinct()
    return topology.check_topology(machines, links.unionByName(events.select(F.lit(0).cast("bigint").alias("src"), F.lit(True).alias("src_is_switch"), "dst", F.lit(True).alias("dst_is_switch"))))
