"""Workloads from a cleaned trace: units, flavors, in-network composites and their edges.

Draws are hashes of a seed and a row's keys, so they don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.expressions import hash_unit, kappa_reduce, switch_resources
from tracelab.sources.scratch import materialize

CPU_UNITS, MEM_UNITS = 9600, 100


def global_ordinal(df: DataFrame, keys: Sequence[str], name: str = "ordinal") -> DataFrame:
    """0..n-1 in the global order of keys: places within range partitions plus what lies before them. No task sees all rows."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    fixed = materialize(ranged, "ordinal")
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    placed = fixed.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return placed.join(F.broadcast(counts.select("_part", "_before")), "_part").select(*df.columns, (F.col("_before") + F.col("_k") - 1).alias(name))


def normalize_units(tgs: DataFrame, max_duration: int, makespan: bool = False, prefix: str = "tg-") -> DataFrame:
    """Seconds to ms, shares of memory and cpu, capped durations; all at once in makespan mode."""
    submit = F.lit(0).cast("bigint") if makespan else F.col("submit") * 1000
    return tgs.withColumns({"original_submit": F.col("submit") * 1000, "submit": submit, "duration": F.least(F.col("duration") * 1000, F.lit(max_duration)), "mem": F.col("mem") / MEM_UNITS, "cpu": F.col("cpu") / CPU_UNITS, "task_group": F.concat(F.lit(prefix), "task_group")})


def trace_window(tgs: DataFrame, start: int, end: int) -> DataFrame:
    return tgs.where(F.col("original_submit").between(start, end))


def largest_demand(tgs: DataFrame) -> DataFrame:
    return tgs.agg(F.max("cpu").alias("max_cpu"), F.max("mem").alias("max_mem"))


def scale_resources(tgs: DataFrame, most: int) -> DataFrame:
    """Demand in machine units, and the reason of rows whose demand isn't in (0, most]."""
    cpu, mem = (F.floor(F.col(c) * most).cast("bigint") for c in ("cpu", "mem"))
    out = tgs.withColumn("resources", F.array(cpu, mem))
    return out.withColumn("reason", F.when(F.exists("resources", lambda x: (x <= 0) | (x > most)), "resources"))


def job_header(tgs: DataFrame) -> DataFrame:
    return tgs.groupBy("job").agg(F.min("submit").alias("submitted"), F.bool_or(F.col("type") == "container").alias("is_high_priority"), F.bool_or(F.col("type") == "DAG").alias("all_to_all"))


def select_flavored_jobs(jobs: DataFrame, mu: float, start_time: int = 0, seed: int = 0, block: int = 100) -> DataFrame:
    """jobs with flavored: in each block of consecutive jobs from the start time on, the share mu of them, rounded, drawn by hash."""
    numbered = global_ordinal(jobs.where(F.col("submitted") >= start_time), ["submitted", "job"])
    w = Window.partitionBy(F.floor(F.col("ordinal") / block))
    rank = F.row_number().over(w.orderBy(hash_unit(seed, F.col("job")), "job"))
    chosen = numbered.withColumn("flavored", rank <= F.round(F.count("*").over(w) * mu))
    return chosen.unionByName(jobs.where(F.col("submitted") < start_time).withColumn("ordinal", F.lit(None).cast("bigint")).withColumn("flavored", F.lit(False)))


def select_flavored_tgs(tgs: DataFrame, ratio: float) -> DataFrame:
    """tgs with tg_flavored: of a flavored job, the first max(1, ceil(n * ratio)) groups with instances."""
    able = F.col("flavored") & (F.col("instances") >= 1)
    w = Window.partitionBy("job")
    rank = F.row_number().over(w.orderBy((~able).cast("int"), "submit", "task_group"))
    return tgs.withColumn("tg_flavored", able & (rank <= F.greatest(F.lit(1), F.ceil(F.count_if(able).over(w) * ratio))))


def assign_inc_type(tgs: DataFrame, types: Sequence[str], seed: int = 0) -> DataFrame:
    """tgs with inc_type: each run of len(types) consecutive groups gets every type once, in an order drawn by hash."""
    n = len(types)
    numbered = global_ordinal(tgs, ["submit", "job", "task_group"])
    block = F.floor(F.col("ordinal") / n)
    order = F.array_sort(F.array(*[F.struct(hash_unit(seed, block, F.lit(t)).alias("u"), F.lit(t).alias("t")) for t in types]))
    return numbered.withColumn("inc_type", F.element_at(order, (F.col("ordinal") % n + 1).cast("int"))["t"]).drop("ordinal")


def reduce_by_kappa(tgs: DataFrame, k_runtime: float, k_tasks: float, seed: int = 0, random: bool = True, units: Sequence[Column] | None = None) -> DataFrame:
    """reduced_duration and reduced_tasks of in-network variants. units are two draws in [0, 1) that take the place of hashes."""
    drawn = units or [hash_unit(seed + k, F.col("job"), F.col("task_group")) if random else F.lit(1.0) for k in range(2)]
    return tgs.withColumns({"reduced_duration": kappa_reduce(F.col("duration"), k_runtime, drawn[0]), "reduced_tasks": kappa_reduce(F.col("instances"), k_tasks, drawn[1])})


TREE, FLAT, RATE, CHAIN = ("daiet", "sharp"), ("incbricks", "netcache", "distcache"), ("hovercraft", "r2p2", "harmonia"), ("netchain",)
#: Demand of one switch by in-network type, as least and most of recirculation in percent, stages, and SRAM
#: in steps of so many kB. The most stages of r2p2 go with a group's tasks, see _most_stages.
DEMAND = {
    "daiet": ((10, 10), (1, 1), (10, 10), 1000),
    "sharp": ((0, 0), (0, 0), (1, 7), 1000),
    "incbricks": ((40, 40), (4, 7), (3, 11), 1000),
    "netcache": ((0, 9), (0, 7), (6, 11), 1000),
    "distcache": ((0, 9), (0, 7), (6, 11), 1000),
    "hovercraft": ((0, 10), (1, 18), (1, 128), 1),
    "r2p2": ((0, 30), (1, 47), (1, 63), 1),
    "harmonia": ((0, 0), (1, 3), (768, 2047), 1),
    "netchain": ((0, 10), (0, 8), (6, 11), 1000),
}


def _most_stages(name: str, most: int, tasks: Column) -> Column:
    """A switch of r2p2 has fewer stages than its group has tasks, and one at least."""
    return F.greatest(F.lit(1), F.least(F.lit(most), tasks - 1)) if name == "r2p2" else F.lit(most)


def switch_demand(inc_type: Column, tasks: Column, draws: Sequence[Column], most: int) -> Column:
    """Demand in switch units of one switch of a type, from three draws in [0, 1)."""
    out = F.lit(None).cast("array<bigint>")
    for name, (recirculation, stages, sram, step) in DEMAND.items():
        ends = (recirculation[0], F.lit(recirculation[1])), (stages[0], _most_stages(name, stages[1], tasks)), (sram[0], F.lit(sram[1]))
        a, b, c = (F.floor(lo + u * (hi - lo + 1)) for (lo, hi), u in zip(ends, draws, strict=True))
        out = F.when(inc_type == name, switch_resources(a, b, c * step / 1000, most)).otherwise(out)
    return out


def switch_count(inc_type: Column, tasks: Column) -> Column:
    ln = F.ceil(F.log(F.greatest(tasks, F.lit(1)).cast("double")))
    return F.when(inc_type.isin(*TREE), F.greatest(F.lit(1), ln)).when(inc_type.isin(*FLAT), F.greatest(F.lit(3), ln)).when(inc_type.isin(*RATE), F.greatest(F.lit(1), F.floor(tasks / 9000))).otherwise(F.greatest(F.lit(3), F.floor(tasks * 3 / 1000))).cast("int")


def _children(n: Column) -> Column:
    """Switches below the root of a tree: binary levels until they make at least n - 1, none for n = 1."""
    levels = F.ceil(F.log2((n - 1) / 2 + 1))
    return F.when(n <= 1, 0).otherwise(F.pow(F.lit(2), levels + 1) - 2).cast("int")


def expand_composites(tgs: DataFrame, most: int, seed: int = 0, draws: Sequence[Column] | None = None) -> DataFrame:
    """Flavored groups (with inc_type, reduced_*) as their parts, other groups as they are.

    Columns of tgs and part (server, inc_server, switch, child), part_name, parent (of a tree's switch), is_switch,
    tasks, part_duration, part_resources, part_all_to_all. draws are three columns in [0, 1) that take the place of
    hashes. Parts of a group are made from its row in one pass.
    """
    drawn = draws or [hash_unit(seed + 10 + k, F.col("job"), F.col("task_group")) for k in range(3)]
    n, tree = switch_count(F.col("inc_type"), F.col("instances")), F.col("inc_type").isin(*TREE)
    demand = switch_demand(F.col("inc_type"), F.col("instances"), drawn, most)
    sized = tgs.withColumns({"_n": n, "_demand": demand, "_tree": tree, "_below": F.when(tree, _children(n)).otherwise(0)})
    name = lambda head: F.concat(F.lit(head), F.col("task_group"))
    child = lambda i: F.concat(F.lit("child"), i.cast("string"), F.lit(" "), F.col("task_group"))
    server = _part("server", F.col("task_group"), None, False, F.col("instances"), F.col("duration"), F.col("resources"), F.col("type") == "DAG")
    reduced = _part("inc_server", name("inc-server "), None, False, F.col("reduced_tasks"), F.col("reduced_duration"), F.col("resources"), F.lit(False))
    top = _part("switch", F.when(F.col("_tree"), name("root ")).otherwise(name("inc ")), None, True, F.col("_n"), F.col("reduced_duration"), F.col("_demand"), F.col("_tree") | F.col("inc_type").isin("distcache", "netchain"))
    low = lambda i: _part("child", child(i), F.when(i <= 2, name("root ")).otherwise(child(F.floor((i - 1) / 2))), True, F.lit(1), F.col("reduced_duration"), F.col("_demand"), F.lit(False))
    children = F.when(F.col("_below") > 0, F.transform(F.sequence(F.lit(1), F.col("_below")), low)).otherwise(F.array().cast(f"array<{_PART}>"))
    parts = F.when(F.col("tg_flavored"), F.concat(F.array(server, reduced, top), children)).otherwise(F.array(server))
    return sized.select(*tgs.columns, F.explode(parts).alias("_part")).select(*tgs.columns, "_part.*")


_PART = "struct<part: string, part_name: string, parent: string, is_switch: boolean, tasks: bigint, part_duration: bigint, part_resources: array<bigint>, part_all_to_all: boolean>"


def _part(part: str, name: Column, parent: Column | None, switch: bool, tasks: Column, duration: Column, resources: Column, all_to_all: Column) -> Column:
    up = parent if parent is not None else F.lit(None)
    fields = {"part": F.lit(part), "part_name": name, "parent": up, "is_switch": F.lit(switch), "tasks": tasks, "part_duration": duration, "part_resources": resources, "part_all_to_all": all_to_all}
    return F.struct(*[x.alias(k) for k, x in fields.items()]).cast(_PART)


def flavor_bits(parts: DataFrame, simple: bool = False) -> DataFrame:
    """parts with in_option and not_in_option: the k-th flavored group of a job has server bit 2k - 1 and in-network bit 2k; in simple mode 1 and 2 for all."""
    k = F.lit(1) if simple else F.dense_rank().over(Window.partitionBy("job", "tg_flavored").orderBy("submit", "task_group"))
    server, inc = F.array((2 * k - 1).cast("int")), F.array((2 * k).cast("int"))
    is_server, none = F.col("part") == "server", F.array().cast("array<int>")
    flavored = F.col("tg_flavored")
    return parts.withColumn("in_option", F.when(~flavored, none).when(is_server, server).otherwise(inc)).withColumn("not_in_option", F.when(~flavored, none).when(is_server, inc).otherwise(server))


def rewire_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges (job, src, dst) between parts: of each trace edge, all ends of its source times all begins of its target; and those inside composites.

    A group begins and ends at its servers, plain and in-network. A tree ends at its root instead of its in-network
    servers; types whose switches talk to servers directly begin and end at their switch instead of these. Inside, a tree
    goes from its in-network servers to its leaves and from each switch to its children; others have both directions
    between in-network servers and switch.
    """
    kind = lambda names: F.coalesce(F.col("inc_type").isin(*names) & F.col("tg_flavored"), F.lit(False))
    tree, flat, part = kind(TREE), kind(FLAT), F.col("part")
    begins = parts.where((part == "server") | (flat & (part == "switch")) | (~flat & (part == "inc_server"))).select("job", F.col("task_group").alias("to"), F.col("part_name").alias("dst"))
    ends = parts.where((part == "server") | ((flat | tree) & (part == "switch")) | (~flat & ~tree & (part == "inc_server"))).select("job", F.col("task_group").alias("from"), F.col("part_name").alias("src"))
    outer = edges.select("job", F.col("src").alias("from"), F.col("dst").alias("to")).join(ends, ["job", "from"]).join(begins, ["job", "to"]).select("job", "src", "dst")
    inner = parts.where("parent is not null").select("job", F.col("parent").alias("src"), F.col("part_name").alias("dst"))
    own = parts.where("is_switch").select("job", "part_name", F.struct("task_group", tree.alias("tree")).alias("own"), F.lit(False).alias("above"))
    above = parts.where("parent is not null").select("job", F.col("parent").alias("part_name"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.lit(True).alias("above"))
    switches = own.unionByName(above).groupBy("job", "part_name").agg(F.collect_list("own").alias("own"), F.bool_or("above").alias("above"))
    leaf = switches.where("not above").select("job", F.explode("own").alias("own"), F.col("part_name").alias("dst")).select("job", "own.task_group", "dst", "own.tree")
    served = parts.where("part = 'inc_server'").select("job", "task_group", F.col("part_name").alias("src")).join(leaf, ["job", "task_group"])
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = served.select("job", F.explode(F.when(F.col("tree"), F.array(there)).otherwise(F.array(there, back))).alias("e")).select("job", "e.src", "e.dst")
    return outer.unionByName(inner).unionByName(both)


def check_jobs(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations (job, part_name, rule) of what must hold for jobs."""
    told = F.array(*[F.struct(F.lit(own).alias("own"), F.col(c).alias("bits")) for own, c in ((True, "in_option"), (False, "not_in_option"))])
    bits = parts.select("job", F.inline(told)).select("job", "own", F.explode("bits").alias("bit")).groupBy("job", "bit").agg(F.bool_and("own").alias("alone"))
    unmet = bits.where("alone").select("job", F.lit(None).cast("string").alias("part_name"), F.lit("option without alternative").alias("rule"))
    rule = F.when(F.arrays_overlap("in_option", "not_in_option"), "contradicting options").when(F.col("tasks") <= 0, "no tasks").when(F.col("part_duration") > F.col("duration"), "longer than the original").when(F.col("is_switch") & (F.coalesce(F.size("part_resources"), F.lit(0)) <= 0), "switch without resources")
    own = parts.select("job", "part_name", rule.alias("rule")).where("rule is not null")
    ends = edges.select("job", F.explode(F.array("src", "dst")).alias("n"), F.lit(False).alias("named"))
    names = parts.where("job is not null and part_name is not null").select("job", F.col("part_name").alias("n"), F.lit(True).alias("named"))
    loose = ends.unionByName(names).groupBy("job", "n").agg(F.bool_or("named").alias("named")).where("not named").select("job", F.col("n").alias("part_name"), F.lit("edge to nowhere").alias("rule"))
    return unmet.unionByName(own).unionByName(loose)


def job_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("submitted", "job")


def job_options(parts: DataFrame) -> DataFrame:
    """Per job: all option bits, how many groups have options, the first submission of one, and the in-network types of its switches."""
    has = F.size("in_option") > 0
    bits = parts.select("job", F.explode("in_option").alias("bit")).groupBy("job").agg(F.sort_array(F.collect_set("bit")).alias("all_options"))
    kinds = parts.where("is_switch").groupBy("job").agg(F.sort_array(F.collect_set("inc_type")).alias("properties"))
    facts = parts.groupBy("job").agg(F.count_if(has).alias("with_options"), F.min(F.when(has, F.col("submit"))).alias("first_option_submit"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return facts.join(bits, "job", "left").join(kinds, "job", "left").select("job", none(F.col("all_options"), "array<int>").alias("all_options"), "with_options", "first_option_submit", none(F.col("properties"), "array<string>").alias("properties"))
