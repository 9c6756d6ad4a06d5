"""The two tables of tenants as of many times, with where their groups ran.

A job is looked at at each time of a short list before its end, and at its end, which serves all later times. Every event goes to the first of its job's
points that sees it; sums, last words on options and machines are carried from there to the later points. Only what a preemption takes back is
spread over the points between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.expressions import definitely_in_flavor, might_be_in_flavor
from tracelab.operators import tenant, topology
from tracelab.sources.scratch import materialize


def locality(present: DataFrame, tgs: DataFrame, edges: DataFrame, machines: DataFrame, links: DataFrame) -> DataFrame:
    """(tg_id, DetourInc, InvolvedRacks, MaxDiameter) of all groups (tg_id, is_switch).

    present: (tg_id, machine_id, is_switch), where groups run; edges: (src_tg, dst_tg) to successors that count. A detour is from a switch group's switches to its
    successors' servers, or from a server group's successors' switches to its servers.
    """
    present, edges, tgs = materialize(present, "present"), materialize(edges, "edges"), materialize(tgs.select("tg_id", "is_switch"), "groups")  # each is met many times below
    next_ = topology.connected_machines(present, edges).join(tgs.select("tg_id", F.col("is_switch").alias("own")), "tg_id").where("is_switch <> own")
    sides = present.select("tg_id", "machine_id", "is_switch").unionByName(next_.select("tg_id", "machine_id", "is_switch")).distinct()
    # Each is written by itself: one stage with all their joins would hold the rows of every one of them in each task.
    detour = materialize(topology.detour_levels(materialize(sides, "sides"), machines, links), "detour")
    racks, far = topology.involved_racks(present, links), materialize(topology.max_diameter(present, edges, links), "diameter")
    out = tgs.select("tg_id", "is_switch").join(detour, "tg_id", "left").join(racks, "tg_id", "left").join(far, "tg_id", "left")
    out = out.join(edges.select(F.col("src_tg").alias("tg_id"), F.lit(True).alias("any")).distinct(), "tg_id", "left")
    alone = F.when(F.col("any"), F.when(F.col("is_switch"), 0).otherwise(1)).otherwise(-1)
    count = lambda c, other, name: F.coalesce(c, other).cast("double").alias(name)
    return materialize(out.select("tg_id", count(F.col("detour"), F.lit(-1), "DetourInc"), count(F.col("racks"), F.lit(0), "InvolvedRacks"), count(F.col("max_diameter"), alone, "MaxDiameter")), "locality")


class _Points:
    """Times at which jobs are looked at."""

    def __init__(self, tgs: DataFrame, job_events: DataFrame, times: Sequence[int]):
        self.times = F.array(*[F.lit(int(t)).cast("bigint") for t in sorted(set(times))])
        last = max(times)
        told = job_events.where(F.col("event").isin("done", "withdraw")).groupBy("job_id").agg(F.min(F.struct("time", "event")).alias("e"))
        self.ends = told.select("job_id", F.col("e.time").alias("end"), F.when(F.col("e.event") == "done", "D").otherwise("W").alias("kind"))
        jobs = tgs.groupBy("job_id").agg(F.min("submitted").alias("first")).join(self.ends, "job_id", "left")
        before = F.filter(self.times, lambda t: (t >= F.col("first")) & (F.col("end").isNull() | (t < F.col("end"))))
        at_end = F.when(F.col("end") <= last, F.array("end")).otherwise(F.array().cast("array<bigint>"))
        rows = jobs.withColumn("at", F.explode(F.concat(before, at_end)))
        over = F.col("end").isNotNull() & (F.col("at") == F.col("end"))
        seen = F.when(over, F.filter(self.times, lambda t: t >= F.col("end"))).otherwise(F.array("at"))
        self.rows = rows.select("job_id", "at", F.when(over, F.col("kind")).alias("kind"), seen.alias("snapshots"))

    def of(self, time: str) -> Column:
        """The first point of the row's job (with its `end`) that sees a time; null if none does."""
        t = F.get(F.filter(self.times, lambda x: x >= F.col(time)), F.lit(0))
        return F.when(t.isNotNull() & (F.col("end").isNull() | (F.col(time) <= F.col("end"))), F.least(t, "end"))


def _options_at(points: _Points, job_events: DataFrame) -> DataFrame:
    """(job_id, at, chosen, excluded): the last word on each bit by each point."""
    told = job_events.where(F.col("event").isin("flavor_chosen", "flavor_removed")).join(points.ends, "job_id", "left").withColumn("at", points.of("time")).where("at is not null")
    words = tenant.bits_told(told, "job_id", "at", "time", "seq", "event").groupBy("job_id", "side", "bit", "at").agg(F.max_by("event", F.struct("time", "seq")).alias("event"))
    dense = points.rows.select("job_id", "at").join(words.select("job_id", "side", "bit").distinct(), "job_id").join(words, ["job_id", "side", "bit", "at"], "left")
    w = Window.partitionBy("job_id", "side", "bit").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    now = dense.withColumn("event", F.last("event", ignorenulls=True).over(w)).where("event = 'flavor_chosen'")
    bits = lambda side, name: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("bit")))).alias(name)
    sets = now.groupBy("job_id", "at").agg(bits("included", "chosen"), bits("excluded", "excluded"))
    none = lambda c: F.coalesce(c, F.array().cast("array<int>")).alias(c)
    return points.rows.join(sets, ["job_id", "at"], "left").select("job_id", "at", "kind", "snapshots", none("chosen"), none("excluded"))


def tenant_tables(
    tgs: DataFrame, allocs: DataFrame, job_events: DataFrame, times: Sequence[int], all_options: DataFrame | None = None,
    edges: DataFrame | None = None, machines: DataFrame | None = None, links: DataFrame | None = None, emit: str = "valid",
) -> tuple[DataFrame, DataFrame]:
    """(task groups, jobs) as their files have them, with a column `snapshot` for each of the times. Jobs that were over by then are as of their end.

    tgs: (tg_id, job_id, submitted, num_tasks, is_switch, duration, original_duration, in_option, not_in_option); allocs: (tg_id, machine_id, start_time,
    num_tasks, preempted_at), the last null for those that never were; job_events: (job_id, seq, time, event, included, excluded) with flavor_chosen, flavor_removed, done
    and withdraw; all_options: (job_id, all_options), for InpStatus. With edges (src_tg, dst_tg) within jobs, machines and links, groups have DetourInc, InvolvedRacks
    and MaxDiameter; successors count once they are submitted and definitely in the flavor. Events after a job's end don't count; what happens at a time does.
    """
    job_events = materialize(job_events, "job-events")  # met many times below, as tgs are
    points = _Points(tgs, job_events, times)
    options = materialize(_options_at(points, job_events), "options")
    ours = allocs.select("tg_id", "machine_id", "start_time", "num_tasks", "preempted_at").join(tgs.select("tg_id", "job_id", "is_switch"), "tg_id").join(points.ends, "job_id", "left")
    ours = ours.withColumns({"p": points.of("start_time"), "q": points.of("preempted_at")}).where("p is not null and (q is null or p < q)")
    ours = materialize(ours.select("job_id", "tg_id", "machine_id", "is_switch", "start_time", F.col("num_tasks").cast("bigint").alias("num_tasks"), "p", "q"), "ours")
    n, weighted = F.col("num_tasks"), (F.col("start_time").cast("decimal(38,0)") * F.col("num_tasks")).cast("decimal(38,0)")
    null = F.lit(None).cast("bigint")
    move = lambda at, n, w, kept, lost: F.struct(at.alias("at"), n.alias("n"), w.cast("decimal(38,0)").alias("w"), kept.alias("kept"), lost.alias("lost"))
    between = F.filter(points.times, lambda t: (t >= F.col("p")) & (t < F.col("q")))
    begun = F.array(move(F.col("p"), n, weighted, F.when(F.col("q").isNull(), F.col("start_time")), null))
    back = F.array(move(F.col("q"), -n, -weighted, null, null))
    held = F.transform(between, lambda t: move(t, F.lit(0).cast("bigint"), F.lit(0), null, F.col("start_time")))
    moves = ours.select("tg_id", F.inline(F.when(F.col("q").isNull(), begun).otherwise(F.concat(begun, back, held))))
    sums = moves.groupBy("tg_id", "at").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("kept").alias("kept"), F.max("lost").alias("lost"))
    w = Window.partitionBy("tg_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = tgs.join(options, "job_id").join(sums, ["tg_id", "at"], "left")
    rows = rows.withColumns({"s": F.coalesce(F.sum("n").over(w), F.lit(0)), "weighted": F.sum("w").over(w), "last": F.greatest(F.max("kept").over(w), "lost")})
    four = [F.col(c) for c in ("in_option", "not_in_option", "chosen", "excluded")]
    lacking = F.sum(F.when(might_be_in_flavor(*four), F.col("num_tasks") - F.col("s")).otherwise(0)).over(Window.partitionBy("job_id", "at"))
    rows = rows.withColumn("JobStatus", F.coalesce("kind", F.when(lacking <= 0, "A").otherwise("O"))).where("submitted <= at")
    rows = materialize(rows.drop("first", "kept", "lost", "n", "w"), "rows")
    groups = tenant.taskgroup_table(rows, F.col("at"), emit, ["at", "snapshots"])
    if edges is not None:
        key = lambda c: F.struct(F.col(c).alias("tg"), "at")
        live = points.rows.where("kind is null or kind <> 'W'").select("job_id", "at")
        since = ours.where("q is null").groupBy("job_id", "tg_id", "machine_id", "is_switch").agg(F.min("p").alias("p")).join(live, "job_id").where("at >= p")
        there = ours.where("q is not null").select("tg_id", "machine_id", "is_switch", F.explode(between).alias("at"))
        present = since.select("tg_id", "machine_id", "is_switch", "at").unionByName(there).select(key("tg_id").alias("tg_id"), "machine_id", "is_switch").distinct()
        counts = rows.where(definitely_in_flavor(*four)).select(F.col("tg_id").alias("dst_tg"), "at")
        own = edges.join(counts, "dst_tg").select(key("src_tg").alias("src_tg"), key("dst_tg").alias("dst_tg"))
        where = locality(present, rows.select(key("tg_id").alias("tg_id"), "is_switch"), own, machines, links)
        where = where.select(F.col("tg_id.tg").alias("TaskGroupID"), F.col("tg_id.at").alias("at"), "DetourInc", "InvolvedRacks", "MaxDiameter")
        groups = groups.join(where, ["TaskGroupID", "at"], "left")
    jobs = rows.select("at", "snapshots", F.col("job_id").alias("JobID"), "JobStatus").distinct().join(tenant.job_stats(groups, keys=["at"]), ["at", "JobID", "JobStatus"], "left")
    jobs = jobs.fillna(0, ["InvolvedTGCnt", "TasksTotal", "TasksStarted", "AvgTaskQueueing", "AvgTaskDuration", "AvgTaskDurationOriginal"])  # none of its groups might be in the flavor
    if all_options is not None:
        inp = options.join(all_options, "job_id").select("at", F.col("job_id").alias("JobID"), tenant.inp_status(F.col("all_options"), F.col("chosen")).alias("InpStatus"))
        jobs = jobs.join(inp, ["at", "JobID"], "left")
    shown = lambda df: df.withColumn("snapshot", F.explode("snapshots")).drop("snapshots", "at")
    return shown(groups), shown(jobs)
