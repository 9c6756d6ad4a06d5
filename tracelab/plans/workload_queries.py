"""Queries: workloads from cleaned jobs of the trace views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.expressions import switch_resources
from tracelab.operators import clean, workload
from tracelab.plans.registry import query, rounded
from tracelab.plans.trace_queries import TIMED, _judged
from tracelab.sources.scratch import materialize

MAX_DURATION, START, END, MOST = 2_000_000, 50_000_000_000, 150_000_000_000, 10_000
TYPES = ("daiet", "distcache", "harmonia", "hovercraft", "incbricks", "netcache", "netchain", "r2p2", "sharp")

GOOD = f"{TIMED}, good as (select job, type, tg_start as submit, duration, name as task_group, instances, mem, cpu from judged where job not in (select job from judged where reason is not null))"
UNITS = f"{GOOD}, units as (select job, type, submit * 1000 as original_submit, submit * 1000 as submit, least(duration * 1000, {MAX_DURATION}) as duration, concat('tg-', task_group) as task_group, instances, mem / 100 as mem, cpu / 9600 as cpu from good)"
WINDOW = f"{UNITS}, win as (select * from units where original_submit between {START} and {END})"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    good = clean.clean_jobs(clean.drop_jobs_with_bad_tg(_judged(spark, sf))[0].withColumn("connections", F.lit(None).cast("string"))).drop("connections")
    return workload.normalize_units(good, MAX_DURATION)


def _window(spark: SparkSession, sf: str) -> DataFrame:
    return workload.trace_window(_units(spark, sf), START, END)


@query(f"with {UNITS} select job, type, original_submit, submit, duration, task_group, instances, mem, cpu from units", "task_rows")
def b1_normalize_units(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf)


@query(f"with {WINDOW} select job, task_group, submit from win", "task_rows")
def b2_trace_window(spark: SparkSession, sf: str) -> DataFrame:
    return _window(spark, sf).select("job", "task_group", "submit")


@query(f"with {UNITS} select round(max(cpu), 6) as max_cpu, round(max(mem), 6) as max_mem from units", "task_rows")
def b2_largest_demand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(workload.largest_demand(_units(spark, sf)), 6)


@query(f"with {UNITS}, r as (select job, task_group, cast(floor(cpu * 1000) as bigint) as c, cast(floor(mem * 1000) as bigint) as m from units) select job, task_group, c as r0, m as r1, case when c <= 0 or c > 1000 or m <= 0 or m > 1000 then 'resources' end as reason from r", "task_rows")
def b3_scale_resources(spark: SparkSession, sf: str) -> DataFrame:
    out = workload.scale_resources(_units(spark, sf), 1000)
    return out.select("job", "task_group", F.col("resources")[0].alias("r0"), F.col("resources")[1].alias("r1"), "reason")


@query(f"with {UNITS} select job, min(submit) as submitted, bool_or(type = 'container') as is_high_priority, bool_or(type = 'DAG') as all_to_all from units group by job", "task_rows")
def b4_job_header(spark: SparkSession, sf: str) -> DataFrame:
    return workload.job_header(_units(spark, sf))


@query(
    f"""with {UNITS}, h as (select job, min(submit) as submitted from units group by job), n as (select *, (row_number() over (order by submitted, job) - 1) // 100 as block from h where submitted >= 60000000000)
select block, count(*) as jobs, cast(round(count(*) * 0.25) as bigint) as flavored from n group by block""",
    "task_rows",
)
def b5_select_flavored_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs and flavored ones in each block of a hundred."""
    out = workload.select_flavored_jobs(workload.job_header(_units(spark, sf)), 0.25, 60_000_000_000)
    return out.where("ordinal is not null").groupBy(F.floor(F.col("ordinal") / 100).alias("block")).agg(F.count("*").alias("jobs"), F.count_if("flavored").alias("flavored"))


def _flavored(rows: DataFrame) -> DataFrame:
    jobs = workload.select_flavored_jobs(workload.job_header(rows), 0.5, 0).select("job", "flavored")
    return workload.select_flavored_tgs(rows.join(jobs, "job"), 0.5)


@query(
    f"""with {UNITS}, f as (select *, row_number() over (partition by job order by case when instances >= 1 then 0 else 1 end, submit, task_group) as k, count(*) filter (where instances >= 1) over (partition by job) as n from units)
select job, task_group, instances >= 1 and k <= greatest(1, ceil(n * 0.5)) as tg_flavored from f""",
    "task_rows",
)
def b6_select_flavored_tgs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _units(spark, sf).withColumn("flavored", F.lit(True))
    return workload.select_flavored_tgs(rows, 0.5).select("job", "task_group", "tg_flavored")


@query(f"with {UNITS}, n as (select row_number() over (order by submit, job, task_group) - 1 as i from units) select i // 9 as block, count(*) as groups, count(*) as types from n group by 1", "task_rows")
def b7_assign_inc_type(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and distinct types in each run of as many groups as there are types."""
    typed = workload.assign_inc_type(_units(spark, sf), TYPES)
    placed = workload.global_ordinal(typed, ["submit", "job", "task_group"])
    return placed.groupBy(F.floor(F.col("ordinal") / 9).alias("block")).agg(F.count("*").alias("groups"), F.count_distinct("inc_type").alias("types"))


#: Draws of the queries below, from what a group has: two for kappa, three for the demand of switches.
KAPPA = ("(instances % 7) / 7", "(duration // 1000 % 11) / 11")
DRAWS = ("(instances % 17) / 17", "(duration // 1000 % 13) / 13", "(instances % 11) / 11")
REDUCED = f"cast(ceil(duration * ({KAPPA[0]} * (1 - 0.85::double) + 0.85::double)) as bigint) as reduced_duration, cast(ceil(instances * ({KAPPA[1]} * (1 - 0.8::double) + 0.8::double)) as bigint) as reduced_tasks"


def _draw(text: str) -> F.Column:
    return F.expr(text.replace("//", "div"))


def _reduced(rows: DataFrame) -> DataFrame:
    return workload.reduce_by_kappa(rows, 0.85, 0.8, units=[_draw(x) for x in KAPPA])


@query(f"with {UNITS} select job, task_group, {REDUCED} from units", "task_rows")
def b8_reduce_by_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """With draws from the groups themselves."""
    return _reduced(_units(spark, sf)).select("job", "task_group", "reduced_duration", "reduced_tasks")


@query("select l_orderkey, l_linenumber, cast(floor(floor(l_discount * 1000) / 100) as bigint) as r0, cast(floor(l_linenumber * 100 / 48.0) as bigint) as r1, cast(floor(floor(l_quantity * 100) / 22) as bigint) as r2 from lineitem")
def b9_switch_resources(spark: SparkSession, sf: str) -> DataFrame:
    r = switch_resources(F.col("l_discount") * 10, F.col("l_linenumber"), F.col("l_quantity"), 100)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", r.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", *[F.col("r")[k].alias(f"r{k}") for k in range(3)])


def parts(rows: DataFrame) -> DataFrame:
    typed = workload.assign_inc_type(_flavored(rows), TYPES)
    scaled = workload.scale_resources(workload.reduce_by_kappa(typed, 0.85, 0.8), 1000)
    return workload.flavor_bits(workload.expand_composites(scaled.where("reason is null"), MOST))


_between = lambda k, least, most: f"floor({least} + {DRAWS[k]} * ({most} - {least} + 1))"
_names = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
_LN = "ceil(ln(greatest(instances, 1)))"
#: The parts of groups of which every other is flavored, with each type in turn, and their edges, in SQL.
PARTS = f"""{UNITS}, fit as (select *, cast(floor(cpu * 1000) as bigint) as c, cast(floor(mem * 1000) as bigint) as m from units), typed as (
  select *, instances % 2 = 1 as flavored, [{_names(TYPES)}][instances // 2 % 9 + 1] as t, {REDUCED} from fit where c between 1 and 1000 and m between 1 and 1000
), sized as (
  select *, cast(case when t in ({_names(workload.TREE)}) then greatest(1, {_LN}) when t in ({_names(workload.FLAT)}) then greatest(3, {_LN}) when t = 'netchain' then greatest(3, instances * 3 // 1000) else greatest(1, instances // 9000) end as bigint) as n,
    case t when 'daiet' then 10 when 'incbricks' then 40 when 'netcache' then {_between(0, 0, 9)} when 'distcache' then {_between(0, 0, 9)} when 'hovercraft' then {_between(0, 0, 10)} when 'netchain' then {_between(0, 0, 10)} when 'r2p2' then {_between(0, 0, 30)} else 0 end as recirculation,
    case t when 'daiet' then 1 when 'incbricks' then {_between(1, 4, 7)} when 'netcache' then {_between(1, 0, 7)} when 'distcache' then {_between(1, 0, 7)} when 'hovercraft' then {_between(1, 1, 18)} when 'r2p2' then {_between(1, 1, "(greatest(2, least(48, instances)) - 1)")} when 'harmonia' then {_between(1, 1, 3)} when 'netchain' then {_between(1, 0, 8)} else 0 end as stages,
    case t when 'daiet' then 10 when 'sharp' then {_between(2, 1, 7)} when 'incbricks' then {_between(2, 3, 11)} when 'hovercraft' then {_between(2, 1, 128)} / 1000 when 'r2p2' then {_between(2, 1, 63)} / 1000 when 'harmonia' then {_between(2, 768, 2047)} / 1000 else {_between(2, 6, 11)} end as sram
  from typed
), demands as (
  select *, case when t in ({_names(workload.TREE)}) then 'tree' when t in ({_names(workload.FLAT)}) then 'flat' else 'other' end as kind,
    cast(floor(floor(recirculation * {MOST}) / 100) as bigint) as s0, cast(floor(stages * {MOST} / 48) as bigint) as s1, cast(floor(floor(sram * {MOST}) / 22) as bigint) as s2,
    case when t in ({_names(workload.TREE)}) and n > 1 then cast(pow(2, ceil(log2((n + 1) / 2)) + 1) as bigint) - 2 else 0 end as below
  from sized
), parts as (
  select job, task_group, flavored, kind, 'server' as part, task_group as part_name, null as parent, false as is_switch, instances as tasks, duration as part_duration, c as r0, m as r1, null::bigint as r2, type = 'DAG' as part_all_to_all from demands
  union all select job, task_group, flavored, kind, 'inc_server', 'inc-server ' || task_group, null, false, reduced_tasks, reduced_duration, c, m, null, false from demands where flavored
  union all select job, task_group, flavored, kind, 'switch', case kind when 'tree' then 'root ' else 'inc ' end || task_group, null, true, n, reduced_duration, s0, s1, s2, kind = 'tree' or t in ('distcache', 'netchain') from demands where flavored
  union all select job, task_group, flavored, kind, 'child', 'child' || i || ' ' || task_group, case when i <= 2 then 'root ' || task_group else 'child' || ((i - 1) // 2) || ' ' || task_group end, true, 1, reduced_duration, s0, s1, s2, false
  from (select *, unnest(range(1, below + 1)) as i from demands where flavored)
)"""


def _drawn_parts(units: DataFrame) -> DataFrame:
    rows = workload.scale_resources(_reduced(units), 1000).where("reason is null").withColumn("tg_flavored", F.col("instances") % 2 == 1)
    kinds = F.array(*[F.lit(t) for t in TYPES])
    return workload.expand_composites(rows.withColumn("inc_type", kinds[F.expr("cast(instances div 2 % 9 as int)")]), MOST, draws=[_draw(x) for x in DRAWS])


@query(f"with {PARTS} select job, task_group, part, part_name, parent, is_switch, tasks, part_duration, part_all_to_all, r0, r1, r2 from parts", "task_rows")
def b10_expand_composites(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("part_resources")
    return _drawn_parts(_units(spark, sf)).select("job", "task_group", "part", "part_name", "parent", "is_switch", "tasks", "part_duration", "part_all_to_all", *[F.get(r, F.lit(k)).alias(f"r{k}") for k in range(3)])


@query(f"with {UNITS}, f as (select job, task_group, dense_rank() over (partition by job order by submit, task_group) as k from units) select job, task_group, cast(2 * k as int) as inc_bit, cast(2 * k - 1 as int) as server_bit from f", "task_rows")
def b11_flavor_bits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _units(spark, sf).withColumn("tg_flavored", F.lit(True)).withColumn("part", F.lit("inc_server"))
    return workload.flavor_bits(rows).select("job", "task_group", F.col("in_option")[0].alias("inc_bit"), F.col("not_in_option")[0].alias("server_bit"))


def _edges(rows: DataFrame) -> DataFrame:
    """Edges between consecutive groups of a job."""
    rows = rows.select("job", "task_group")
    n = F.regexp_extract("task_group", "([0-9]+)", 1).cast("int")
    return rows.select("job", F.col("task_group").alias("src"), F.concat(F.lit("tg-T"), (n + 1).cast("string")).alias("dst")).join(rows.select("job", F.col("task_group").alias("dst")), ["job", "dst"])


@query(f"with {UNITS}, e as (select a.job, a.task_group as src, b.task_group as dst from units a join units b on a.job = b.job and cast(substr(b.task_group, 5) as int) = cast(substr(a.task_group, 5) as int) + 1) select job, src, dst from e", "task_rows")
def b12_rewire_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Without flavors, the trace's edges as they are."""
    rows = _units(spark, sf).withColumns({"tg_flavored": F.lit(False), "inc_type": F.lit(None).cast("string"), "part": F.lit("server"), "part_name": F.col("task_group"), "parent": F.lit(None).cast("string"), "is_switch": F.lit(False)})
    return workload.rewire_edges(_edges(_units(spark, sf)), rows).select("job", "src", "dst")


@query(
    f"""with {PARTS}, arcs as (select a.job, a.task_group as src, b.task_group as dst from units a join units b on a.job = b.job and cast(substr(b.task_group, 5) as int) = cast(substr(a.task_group, 5) as int) + 1),
ends as (select job, task_group, part_name, part = 'server' or (kind = 'flat' and part = 'switch') or (kind <> 'flat' and part = 'inc_server') as begins, part = 'server' or (kind in ('flat', 'tree') and part = 'switch') or (kind = 'other' and part = 'inc_server') as ends from parts),
leaves as (select * from parts p where is_switch and not exists (select 1 from parts c where c.job = p.job and c.parent = p.part_name)),
served as (select s.job, s.part_name as src, l.part_name as dst, l.kind from parts s join leaves l using (job, task_group) where s.part = 'inc_server')
select a.job, x.part_name as src, y.part_name as dst from arcs a join ends x on x.job = a.job and x.task_group = a.src and x.ends join ends y on y.job = a.job and y.task_group = a.dst and y.begins
union all select job, parent, part_name from parts where parent is not null union all select job, src, dst from served union all select job, dst, src from served where kind <> 'tree'""",
    "task_rows",
)
def b12_rewire_composites(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the parts of groups of all nine types, flavored and not."""
    units = materialize(_units(spark, sf), "units")  # met three times
    return workload.rewire_edges(_edges(units), materialize(_drawn_parts(units), "parts"))


@query(f"with {UNITS} select job, task_group, row_number() over (order by submit, job, task_group) - 1 as ordinal from units", "task_rows")
def b13_global_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return workload.global_ordinal(_units(spark, sf).select("job", "task_group", "submit"), ["submit", "job", "task_group"]).drop("submit")


@query(f"with {UNITS} select job, rule, count(*) as rows from (select job, 'longer than the original' as rule from units where duration % 7000 = 0 union all select job, 'edge to nowhere' from units where duration % 11000 = 0) group by 1, 2", "task_rows")
def b14_check_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of a workload in which groups of some durations were made longer and others have an edge to a group that isn't there: those, and none of composites as they are made."""
    units = materialize(_units(spark, sf), "units")  # met six times below
    made = materialize(parts(units), "made-parts")
    plain = units.withColumns({"tg_flavored": F.lit(False), "part": F.lit("server"), "part_name": F.col("task_group"), "is_switch": F.lit(False), "tasks": F.lit(1), "part_resources": F.array(F.lit(1)), "in_option": F.array().cast("array<int>"), "not_in_option": F.array().cast("array<int>")})
    plain = plain.withColumn("part_duration", F.col("duration") + F.when(F.col("duration") % 7000 == 0, 1).otherwise(0))
    right = workload.check_jobs(made, workload.rewire_edges(_edges(units), made))
    loose = units.where("duration % 11000 = 0").select("job", F.col("task_group").alias("src"), F.concat(F.lit("not "), "task_group").alias("dst"))
    wrong = workload.check_jobs(plain, _edges(units).unionByName(loose))
    return wrong.unionByName(right).groupBy("job", "rule").agg(F.count("*").alias("rows"))


@query(f"with {UNITS} select job, min(submit) as submitted from units group by job", "task_rows")
def b15_job_order(spark: SparkSession, sf: str) -> DataFrame:
    return workload.job_order(workload.job_header(_units(spark, sf))).select("job", "submitted")


@query(f"with {UNITS} select job, 2 * count(*) as bits, 3 * count(*) as with_options, min(submit) as first_option_submit from units group by job", "task_rows")
def b16_job_options(spark: SparkSession, sf: str) -> DataFrame:
    """Every group flavored as one switch: two bits a group, and three parts with options."""
    rows = _units(spark, sf).withColumns({"tg_flavored": F.lit(True), "inc_type": F.lit("netcache"), "reduced_tasks": F.lit(1), "reduced_duration": F.lit(1), "resources": F.array(F.lit(1).cast("bigint"))})
    out = workload.job_options(workload.flavor_bits(workload.expand_composites(rows, MOST)))
    return out.select("job", F.size("all_options").cast("bigint").alias("bits"), "with_options", "first_option_submit")


