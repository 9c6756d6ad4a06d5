"""Cleaning of raw cluster traces into machines, jobs, task groups and dependency edges.

Where the order of input rows decides, callers pass an order column taken on the scan (see sources.trace.input_order).
Rows that can't be used carry a reason; no scan stops at one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.expressions import map_status, parse_task_name


def first_seen(df: DataFrame, keys: list[str], cols: list[str], order: str) -> DataFrame:
    """Static attributes of a key: those of its first row."""
    first = F.min_by(F.struct(*cols), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("_first")[c].alias(c) for c in cols])


def compress_status(df: DataFrame, keys: list[str], time: str, state: str, order: str) -> DataFrame:
    """Rows, by time and then input order, that are a key's first or last or differ in state from the row before."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    marked = df.withColumn("_before", F.lag(state).over(w)).withColumn("_k", F.row_number().over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    return marked.where((F.col("_k") == 1) | F.col("_last") | ~F.col("_before").eqNullSafe(F.col(state))).drop("_before", "_k", "_last")


def machine_reason(cpu: Column, mem: Column, events: Column) -> Column:
    """Why a machine is rejected; null if it isn't."""
    bad = lambda c: c.isNull() | (c < 0)
    return F.when(bad(cpu), "cpu").when(bad(mem), "mem").when(F.coalesce(events, F.lit(0)) < 1, "no event")


def clean_machines(raw: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(clean machine events, rejected rows with reason) of raw machine_meta rows."""
    known = raw.withColumn("available", map_status(F.col("status")))
    static = first_seen(raw, ["machine_id"], ["cpu_num", "mem_size", "failure_domain_1", "failure_domain_2"], order)
    events = known.where("available is not null").groupBy("machine_id").count()
    judged = static.join(events, "machine_id", "left").withColumn("reason", machine_reason(F.col("cpu_num"), F.col("mem_size"), F.col("count")))
    kept = compress_status(known.where("available is not null"), ["machine_id"], "time_stamp", "available", order)
    good = kept.select("machine_id", "available", F.col("time_stamp").alias("time")).join(judged.where("reason is null"), "machine_id")
    good = good.select(F.col("machine_id").alias("machine"), F.col("cpu_num").alias("cpu"), F.col("mem_size").alias("mem"), F.col("failure_domain_1").alias("failure_d_1"), F.col("failure_domain_2").alias("failure_d_2"), "available", "time")
    rejects = judged.where("reason is not null").select("machine_id", "reason").unionByName(known.where("available is null").select("machine_id", F.lit("status").alias("reason")))
    return good, rejects


def container_intervals(raw: DataFrame, order: str = "ord") -> DataFrame:
    """Containers as jobs of one task group each instance: start at the first start or allocation, end at the last stop."""
    begins, ends = F.col("status").isin("started", "allocated"), F.col("status") == "stopped"
    static = F.min_by(F.struct("cpu_request", "mem_size"), F.col(order)).alias("s")
    times = raw.where(F.col("status").isin("started", "allocated", "stopped", "unknow")).groupBy("app_du", "container_id")
    out = times.agg(F.min(F.when(begins, F.col("time_stamp"))).alias("start_time"), F.max(F.when(ends, F.col("time_stamp"))).alias("end_time"), static, F.min(order).alias("ord"))
    return out.select(F.concat(F.lit("container"), "app_du").alias("job"), F.lit("container").alias("type"), F.col("container_id").alias("name"), F.lit(1).cast("bigint").alias("instances"), F.col("s.cpu_request").cast("double").alias("cpu"), F.col("s.mem_size").alias("mem"), "start_time", "end_time", F.lit(None).cast("string").alias("prefix"), F.array().cast("array<int>").alias("deps"), "ord")


def merge_task_rows(raw: DataFrame, order: str = "ord", deps: str = "last") -> DataFrame:
    """One row for each (job, task): the last instances, cpu and mem that are given, the last positive times else 0, dependencies of the first row.

    Rows whose name has no known form are left out (see task_rejects).
    """
    rows = raw.withColumn("t", parse_task_name(F.col("task_name"), deps)).where("t is not null and start_time >= 0 and end_time >= 0")
    last = lambda c, keep: F.max_by(F.when(keep, F.col(c)), F.when(keep, F.col(order)))
    merged = rows.groupBy(F.col("job_name").alias("job"), F.col("t.name").alias("name")).agg(
        *[last(c, F.col(c).isNotNull()).alias(to) for c, to in (("instance_num", "instances"), ("plan_cpu", "cpu"), ("plan_mem", "mem"))],
        *[F.coalesce(last(c, F.col(c) > 0), F.lit(0)).alias(c) for c in ("start_time", "end_time")],
        F.min_by(F.struct("t.prefix", "t.deps"), F.col(order)).alias("first"),
        F.min(order).alias("ord"),
    )
    return merged.select("job", F.lit("DAG").alias("type"), "name", "instances", "cpu", "mem", "start_time", "end_time", F.col("first.prefix").alias("prefix"), F.col("first.deps").alias("deps"), "ord")


def task_rejects(raw: DataFrame) -> DataFrame:
    """Rows that merge_task_rows leaves out, with the reason."""
    reason = F.when(parse_task_name(F.col("task_name")).isNull(), "task name").when((F.col("start_time") < 0) | (F.col("end_time") < 0), "time")
    return raw.withColumn("reason", reason).where("reason is not null")


def trace_horizon(*frames: tuple[DataFrame, list[str]]) -> DataFrame:
    """One row: the largest time (column horizon) in the given columns."""
    parts = [df.agg(F.max(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in cols], F.lit(0))).alias("horizon")) for df, cols in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.max("horizon").alias("horizon"))


def union_jobs(containers: DataFrame, tasks: DataFrame) -> DataFrame:
    return containers.unionByName(tasks)


def normalize_tg_times(tgs: DataFrame, horizon: DataFrame) -> DataFrame:
    """job_submit (least start of the job, else 0), tg_start, tg_end and duration; open ends reach the horizon, empty ones get 1."""
    submit = F.coalesce(F.min("start_time").over(Window.partitionBy("job")), F.lit(0))
    timed = tgs.crossJoin(F.broadcast(horizon)).withColumn("job_submit", submit).withColumn("tg_start", F.coalesce("start_time", "job_submit"))  # horizon: one row
    end = F.when(F.coalesce("end_time", F.lit(0)) == 0, F.col("horizon")).otherwise(F.col("end_time"))
    timed = timed.withColumn("tg_end", F.when(end == F.col("tg_start"), end + 1).otherwise(end)).drop("horizon")
    return timed.withColumn("duration", F.col("tg_end") - F.col("tg_start"))


#: The most CPU (in hundredths of a core) and memory (in percent) that a task group may ask for.
MOST_CPU, MOST_MEM = 9600, 100


def tg_reason() -> Column:
    """Why a task group is rejected; null if it isn't."""
    bad = lambda c, most: F.col(c).isNull() | (F.col(c) <= 0) | (F.col(c) > most)
    return F.when(F.col("instances").isNull(), "instances").when(bad("cpu", MOST_CPU), "cpu").when(bad("mem", MOST_MEM), "mem").when(F.col("duration") <= 0, "duration")


def validate_tgs(tgs: DataFrame) -> DataFrame:
    return tgs.withColumn("reason", tg_reason())


def drop_jobs_with_bad_tg(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups of jobs without a rejected group, rejected groups): one bad group rejects its job."""
    bad = judged.where("reason is not null")
    return judged.join(bad.select("job").distinct(), "job", "left_anti").drop("reason"), bad


def build_dag(tgs: DataFrame, match: str = "prefix") -> DataFrame:
    """Edges (job, src, dst) from each dependency to its task. match="prefix": a dependency has the task's own letters;
    "number": any task of the job with that number. Dependencies that aren't there are ignored."""
    wants = tgs.select("job", F.col("name").alias("dst"), "prefix", F.explode("deps").alias("dep"))
    if match == "prefix":
        return wants.join(tgs.select("job", F.col("name").alias("src")), (wants["job"] == tgs["job"]) & (F.concat("prefix", F.col("dep").cast("string")) == F.col("src"))).select(wants["job"], "src", "dst")
    numbered = tgs.where("prefix is not null").select(F.col("job").alias("j"), F.col("name").alias("src"), F.regexp_extract("name", "([0-9]+)$", 1).try_cast("int").alias("n"))
    return wants.join(numbered, (F.col("job") == F.col("j")) & (F.col("dep") == F.col("n"))).select("job", "src", "dst")


def connections(tgs: DataFrame, edges: DataFrame) -> DataFrame:
    """tgs with the successors of each group, by name, joined by an underscore; null without any."""
    after = edges.groupBy("job", F.col("src").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("dst")), "_").alias("connections"))
    return tgs.join(after, ["job", "name"], "left")


def order_jobs(tgs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Global order by job submit and group start, ties by first appearance, over part files."""
    keys = ["job_submit", "job", "tg_start", "ord"]
    ranged = tgs.repartitionByRange(partitions, *keys) if partitions else tgs.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def trace_report(judged: DataFrame) -> DataFrame:
    """Jobs that passed and failed by type, and mean and longest duration of passed groups."""
    jobs = judged.groupBy("type", "job").agg(F.max(F.col("reason").isNotNull()).alias("failed"), F.sum("duration").alias("total"), F.count("*").alias("n"), F.max("duration").alias("longest"))
    passed = ~F.col("failed")
    return jobs.groupBy("type").agg(
        F.count_if(passed).alias("passed"), F.count_if(F.col("failed")).alias("rejected"), F.try_divide(F.sum(F.when(passed, F.col("total"))), F.sum(F.when(passed, F.col("n")))).alias("mean_duration"), F.max(F.when(passed, F.col("longest"))).alias("max_duration")
    )


def clean_jobs(tgs: DataFrame) -> DataFrame:
    """The cleaned jobs table; its submit column is the group's start."""
    return tgs.select("job", "type", F.col("tg_start").alias("submit"), "duration", F.col("name").alias("task_group"), "instances", "mem", "cpu", "connections")
