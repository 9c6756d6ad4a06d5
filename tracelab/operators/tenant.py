"""Statistics of jobs, task groups, the scheduler and its timings, from event logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.expressions import inc_options, might_be_in_flavor
from tracelab.operators.usage import running_by_tick, tick_of


def _bits(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<int>"))


def bits_told(told: DataFrame, *columns: str | Column) -> DataFrame:
    """(columns, side, bit): each bit of either side of flavor events, in one pass over them."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("bits")) for side in ("included", "excluded")])
    both = told.select(*columns, F.inline(sides))
    return both.select(*[c for c in both.columns if c != "bits"], F.explode("bits").alias("bit"))


def job_options_at(job_events: DataFrame, now: int) -> DataFrame:
    """(job_id, chosen, excluded): option bits as of a time; the last word on a bit counts.

    flavor_chosen adds its included bits to chosen and its excluded ones to excluded; flavor_removed takes them away.
    """
    told = job_events.where((F.col("time") <= now) & F.col("event").isin("flavor_chosen", "flavor_removed"))
    last = bits_told(told, "job_id", "seq", "event").groupBy("job_id", "side", "bit").agg(F.max_by("event", "seq").alias("event")).where("event = 'flavor_chosen'")
    sets = last.groupBy("job_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("bit")))).alias(to) for side, to in (("included", "chosen"), ("excluded", "excluded"))])
    return told.select("job_id").distinct().join(sets, "job_id", "left").select("job_id", _bits(F.col("chosen")).alias("chosen"), _bits(F.col("excluded")).alias("excluded"))


def job_status(withdrawn: Column, done: Column, started: Column, total: Column) -> Column:
    """W withdrawn, D done, A all tasks allocated, O other."""
    return F.when(withdrawn, "W").when(done, "D").when(started >= total, "A").otherwise("O")


def job_status_at(job_events: DataFrame, tg_stats: DataFrame, now: int) -> DataFrame:
    """(job_id, JobStatus) of all jobs that came by a time. tg_stats: (job_id, total, started) of groups in the flavor."""
    seen = job_events.where(F.col("time") <= now).groupBy("job_id").agg(F.bool_or(F.col("event") == "withdraw").alias("w"), F.bool_or(F.col("event") == "done").alias("d"))
    tasks = tg_stats.groupBy("job_id").agg(F.sum("total").alias("total"), F.sum("started").alias("started"))
    return seen.join(tasks, "job_id", "left").select("job_id", job_status(F.col("w"), F.col("d"), F.coalesce("started", F.lit(0)), F.coalesce("total", F.lit(1))).alias("JobStatus"))


def inp_status(all_options: Column, chosen: Column) -> Column:
    """Y in-network taken, N could have been, S a job without such a flavor."""
    return F.when(~inc_options(all_options), "S").when(inc_options(chosen), "Y").otherwise("N")


def flavor_status(in_option: Column) -> Column:
    """A in every flavor, Y in an in-network one, N in a server one."""
    return F.when(F.size(in_option) == 0, "A").when(inc_options(in_option), "Y").otherwise("N")


def taskgroup_table(rows: DataFrame, now: Column, emit: str = "valid", more: Sequence[str] = ()) -> DataFrame:
    """The task-group file's columns of rows: a group's own columns, JobStatus, chosen and excluded of its job, and s, weighted, last: tasks started, their start times summed, the last one.

    Groups of withdrawn jobs have started nothing. A group is valid while it might be in the flavor. emit="all" keeps the others, marked N.
    """
    alive = F.coalesce(F.col("JobStatus") != "W", F.lit(True))
    started = F.when(alive, F.coalesce("s", F.lit(0))).otherwise(0).cast("bigint")
    waits = F.coalesce(F.when(alive, F.col("weighted")), F.lit(0)) - started * F.col("submitted") + (now - F.col("submitted")) * (F.col("num_tasks") - started)
    valid = might_be_in_flavor(F.col("in_option"), F.col("not_in_option"), _bits(F.col("chosen")), _bits(F.col("excluded")))
    rows = rows.withColumn("ValidForJob", F.when(valid, "Y").otherwise("N"))
    rows = rows if emit == "all" else rows.where("ValidForJob = 'Y'")
    return rows.select(
        *more, F.col("job_id").alias("JobID"), "JobStatus", flavor_status(F.col("in_option")).alias("FlavorInp"), "ValidForJob", F.col("tg_id").alias("TaskGroupID"), F.col("submitted").alias("SubmissionTime"), F.col("num_tasks").alias("TotalTasks"),
        F.when(F.col("is_switch"), "I").otherwise("S").alias("TaskGroupType"), started.alias("TasksStarted"), F.try_divide(waits.cast("double"), F.col("num_tasks")).alias("AvgQueueing"), F.coalesce(F.when(alive, F.col("last")), F.lit(-1)).cast("bigint").alias("PlacementLatency"),
        F.col("duration").alias("Duration"), F.col("original_duration").alias("OriginalDuration"),
    )


def taskgroup_stats(allocs: DataFrame, tgs: DataFrame, options: DataFrame, now: int, locality: DataFrame | None = None, emit: str = "valid") -> DataFrame:
    """The task-group table as of a time.

    allocs: (alloc_id, tg_id, start_time, end_time, num_tasks, preempted); tgs: (tg_id, job_id, submitted, num_tasks, is_switch,
    duration, original_duration, in_option, not_in_option); options: (job_id, chosen, excluded, JobStatus). Preempted
    allocations don't count, nor do any of withdrawn jobs. Queueing is the mean over tasks, those still waiting up to now.
    locality: (tg_id, DetourInc, InvolvedRacks, MaxDiameter), as snapshots.locality() gives them.
    """
    ours = allocs.where((F.col("start_time") <= now) & ~F.col("preempted"))
    begun = ours.groupBy("tg_id").agg(F.sum("num_tasks").alias("s"), F.sum(F.col("start_time").cast("decimal(38,0)") * F.col("num_tasks")).alias("weighted"), F.max("start_time").alias("last"))
    out = taskgroup_table(tgs.where(F.col("submitted") <= now).join(options, "job_id", "left").join(begun, "tg_id", "left"), F.lit(now), emit)
    if locality is not None:
        out = out.join(locality.withColumnRenamed("tg_id", "TaskGroupID"), "TaskGroupID", "left")
    return out


def job_stats(tg_stats: DataFrame, inp: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The job table: tasks and task-weighted means over a job's groups. inp: (keys, job_id, InpStatus)."""
    each = lambda c: F.sum(F.col(c) * F.col("TotalTasks")) / F.greatest(F.lit(1), F.sum("TotalTasks"))
    out = tg_stats.groupBy(*keys, "JobID", "JobStatus").agg(
        F.count("*").alias("InvolvedTGCnt"), F.sum("TotalTasks").alias("TasksTotal"), F.sum("TasksStarted").alias("TasksStarted"), each("AvgQueueing").alias("AvgTaskQueueing"), each("Duration").alias("AvgTaskDuration"), each("OriginalDuration").alias("AvgTaskDurationOriginal")
    )
    return out if inp is None else out.join(inp.withColumnRenamed("job_id", "JobID"), [*keys, "JobID"], "left")


def tenant_snapshots(allocs: DataFrame, tgs: DataFrame, hours: Sequence[int], hour_ms: int = 3_600_000) -> DataFrame:
    """(hour, tg_id, started, waiting): task groups as of each of a short list of hours. An allocation counts from the first hour after its start, and what has started is carried on; snapshots.tenant_tables() gives the whole tables."""
    order = sorted(hours)
    first = lambda time: F.get(F.filter(F.array(*[F.lit(h) for h in order]), lambda h: h * hour_ms >= time), F.lit(0)).cast("int")
    begun = allocs.where("not preempted").withColumn("hour", first(F.col("start_time"))).where("hour is not null").groupBy("tg_id", "hour").agg(F.sum("num_tasks").alias("n"))
    each = tgs.withColumn("hour", F.explode(F.filter(F.array(*[F.lit(h) for h in order]), lambda h: h * hour_ms >= F.col("submitted")))).withColumn("hour", F.col("hour").cast("int"))
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("tg_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    both = each.join(begun, ["tg_id", "hour"], "left").withColumn("started", so_far)
    return both.select("hour", "tg_id", "started", F.greatest(F.lit(0), F.col("num_tasks") - F.col("started")).cast("bigint").alias("waiting"))


#: Counters of the scheduler's statistics file that follow from the logs, in its order.
COUNTERS = (
    "Attempts", "Allocations", "ScheduledTasks", "ThinkTime", "ThinkTimeWasted", "TotalJobsFullyScheduled", "TotalJobsFullyScheduledINP", "TotalJobQueueTime", "CountJobs", "CountJobsWithInp", "CountJobsFinished", "CountJobsFinishedINP",
    "CountPreemptions", "PendingJobsNotFullyScheduledPlusFutureTgSubmissions", "TimesServerFallbackResubmit", "TimesServerFlavorTaken", "TimesSwitchFlavorTaken",
)


def scheduler_counters(alloc_events: DataFrame, job_events: DataFrame, sched_events: DataFrame, interval: int, keys: Sequence[str] = ("run",), pending: DataFrame | None = None) -> DataFrame:
    """Cumulative counters of each run at every tick. The tables are summed by tick first; only ticks are accumulated.

    job_events: (seq, time, event, job_id, options, included) with events submit, flavor_chosen, flavor_removed, resubmit,
    scheduled, done and withdraw. A job is scheduled once, and in-network if its last word on flavors chose one; a removed
    flavor is taken back. sched_events: (time, event, think_time, allocations); an attempt without allocations wastes its
    time. Preemptions are counted in tasks. pending: pending_jobs by keys, whose two counts become columns.
    Wall time and queue lengths of a scheduler's own making aren't in the logs.
    """
    tick = tick_of(F.col("time"), interval).alias("tick")
    long = lambda c: c.cast("bigint")
    when = lambda cond, c=1: long(F.when(cond, c).otherwise(0))
    event = F.col("event")
    so_far = Window.partitionBy(*keys, "job_id").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    # Arrays are asked once a row, before rows are dealt by job.
    own = job_events.select(*keys, "job_id", "seq", "time", "event", inc_options("options").alias("_has_inp"), inc_options("included").alias("_switch"))
    word = F.when(event == "flavor_chosen", F.col("_switch")).when(event == "flavor_removed", F.lit(False))
    left = event.isin("scheduled", "withdraw")
    jobs = own.select(
        *keys, "time", "event", "_has_inp", "_switch", F.coalesce(F.last(word, ignorenulls=True).over(so_far), F.lit(False)).alias("_inp"), F.count_if(event == "scheduled").over(so_far).alias("_scheduled"), F.count_if(left).over(so_far).alias("_left"),
        F.min(F.when(event == "submit", F.col("time"))).over(so_far).alias("_submitted"),
    )
    placed, done = (event == "scheduled") & (F.col("_scheduled") == 1), event == "done"
    taken = F.when(event == "flavor_chosen", 1).when(event == "flavor_removed", -1).otherwise(0)
    parts = [
        (alloc_events, {"Allocations": when(event == "claim"), "ScheduledTasks": when(event == "claim", F.col("num_tasks")), "CountPreemptions": when(event == "preempt", F.col("num_tasks"))}),
        (sched_events, {"Attempts": when(event == "attempt"), "ThinkTime": when(F.col("allocations") > 0, F.coalesce("think_time", F.lit(0))), "ThinkTimeWasted": when(F.col("allocations") == 0, F.coalesce("think_time", F.lit(0)))}),
        (jobs, {
            "TotalJobsFullyScheduled": when(placed), "TotalJobsFullyScheduledINP": when(placed & F.col("_inp")), "TotalJobQueueTime": when(placed, F.coalesce(F.col("time") - F.col("_submitted"), F.lit(0))),
            "CountJobs": when(event == "submit"), "CountJobsWithInp": when((event == "submit") & F.col("_has_inp")), "CountJobsFinished": when(done), "CountJobsFinishedINP": when(done & F.col("_inp")),
            "PendingJobsNotFullyScheduledPlusFutureTgSubmissions": long(F.when(event == "submit", 1).when(left & (F.col("_left") == 1), -1).otherwise(0)), "TimesServerFallbackResubmit": when(event == "resubmit"),
            "TimesServerFlavorTaken": long(F.when(~F.col("_switch"), taken).otherwise(0)), "TimesSwitchFlavorTaken": long(F.when(F.col("_switch"), taken).otherwise(0)),
        }),
    ]
    out = None
    for df, given in parts:
        some = df.select(*keys, tick, *[given.get(n, F.lit(0).cast("bigint")).alias(n) for n in COUNTERS])
        out = some if out is None else out.unionByName(some)
    out = running_by_tick(out, list(keys), list(COUNTERS), interval)
    if pending is not None:
        both = pending.groupBy(*keys, "tick").agg(*[F.sum(F.when(side, F.col("n")).otherwise(0)).alias(name) for side, name in ((~F.col("placed"), "PendingJobsNotFullyScheduled"), (F.col("placed"), "PendingJobsFullyScheduled"))])
        # Beyond its last tick a count stays as it was.
        until = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
        kept = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(until), F.lit(0)).alias(c)
        out = out.join(both, [*keys, "tick"], "left").select(*keys, "tick", *COUNTERS, kept("PendingJobsNotFullyScheduled"), kept("PendingJobsFullyScheduled"))
    return out.withColumnRenamed("tick", "Time")


def state_intervals(spans: DataFrame, interval: int, keys: Sequence[str], last: int | None = None) -> DataFrame:
    """(keys, tick, n): how many spans (since, until) hold at each tick, to the last change or the tick `last`; open ones never end."""
    step = lambda time, n: F.struct(tick_of(F.col(time), interval).alias("tick"), F.lit(n).cast("bigint").alias("n"))
    steps = spans.select(*keys, F.inline(F.array(step("since", 1), step("until", -1)))).where("tick is not null")
    return running_by_tick(steps, list(keys), ["n"], interval, last)


def placed_spans(alloc_events: DataFrame, tgs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tg_id, full_time, lost_time): when all tasks of a group run or have run, until a preemption takes some of them; open ones have no lost_time.

    alloc_events: (keys, tg_id, time, event, num_tasks); tgs: (keys, tg_id, num_tasks). What happens at one time counts together.
    """
    group = [*keys, "tg_id"]
    change = F.when(F.col("event") == "claim", F.col("num_tasks")).when(F.col("event") == "preempt", -F.col("num_tasks"))
    moves = alloc_events.where(F.col("event").isin("claim", "preempt")).groupBy(*group, "time").agg(F.sum(change).alias("d"))
    w = Window.partitionBy(*group).orderBy("time")
    rows = moves.join(tgs.select(*group, F.col("num_tasks").alias("_tasks")), group)
    rows = rows.withColumn("full", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("_tasks"))
    turns = rows.withColumn("was", F.coalesce(F.lag("full").over(w), F.lit(False))).where("full <> was")
    return turns.withColumn("next", F.lead("time").over(w)).where("full").select(*group, F.col("time").alias("full_time"), F.col("next").alias("lost_time"))


def _ruled_out(kinds: DataFrame, options: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, job_id, in_option, not_in_option, time, against): where the number of reasons against groups of a kind in their job's flavor changes: each bit that they rule out and is chosen, each of their own that is excluded."""
    job = [*keys, "job_id"]
    told = options.where(F.col("event").isin("flavor_chosen", "flavor_removed"))
    w = Window.partitionBy(*job, "side", "bit").orderBy("time", "seq")
    turns = bits_told(told, *job, "time", "seq", (F.col("event") == "flavor_chosen").alias("on")).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    against = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("bits")) for side, c in (("included", "not_in_option"), ("excluded", "in_option"))])
    bound = kinds.where(F.size("not_in_option") > 0).select(*job, "in_option", "not_in_option", F.inline(against)).withColumn("bit", F.explode("bits"))
    return turns.join(bound, [*job, "side", "bit"]).select(*job, "in_option", "not_in_option", "time", F.when(F.col("on"), 1).otherwise(-1).alias("against"))


def _pending_once(own: DataFrame, turns: DataFrame, interval: int, keys: Sequence[str], last: int | None = None) -> DataFrame:
    """pending_jobs where a group is placed once and for all. own: (keys, job_id, tg_id, submitted); turns: (keys, tg_id, time).

    Each group tells its moves in one pass: it lacks tasks from before all time (null), as far as submitted ones count from its
    submission, and both until its time. As fewer and fewer lack tasks, running sums by job say all: a job is over once none does.
    """
    job, on = [*keys, "job_id"], [*keys, "tg_id"]
    null = F.lit(None).cast("bigint")
    move = lambda time, lacks, ready, since=null: F.struct(time.cast("bigint").alias("time"), F.lit(lacks).cast("bigint").alias("lacks"), F.lit(ready).cast("bigint").alias("ready"), since.cast("bigint").alias("since"))
    came, time = F.col("submitted"), F.col("time")
    begun = [move(null, 1, 0, came), move(came, 0, 1)]
    turned = F.when(time.isNull(), F.array(*begun)).when(time >= came, F.array(*begun, move(time, -1, -1))).otherwise(F.array(*begun, move(time, -1, 0), move(came, 0, -1)))
    moves = own.join(turns.drop("d"), on, "left").select(*job, F.inline(turned))
    v = Window.partitionBy(*job).orderBy("time")
    now = v.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = moves.select(*job, "time", *[F.sum(c).over(now).alias(c) for c in ("lacks", "ready")], F.min("since").over(now).alias("since"), F.lead("time").over(v).alias("until"))
    spans = swept.where((F.col("time") >= F.col("since")) & (F.col("lacks") > 0) & (F.col("until").isNull() | (F.col("until") > F.col("time"))))
    return state_intervals(spans.select(*keys, (F.col("ready") == 0).alias("placed"), F.col("time").alias("since"), "until"), interval, [*keys, "placed"], last)


def pending_jobs(tgs: DataFrame, started: DataFrame, interval: int, keys: Sequence[str] = (), options: DataFrame | None = None, withdrawn: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """(keys, placed, tick, n): unfinished jobs at each tick, split by whether all groups submitted so far that might be in the flavor are placed.

    tgs: (keys, job_id, tg_id, submitted), with options also (in_option, not_in_option); started: (keys, tg_id, full_time[, lost_time]), when a group's last task
    started, and when it lost one (placed_spans); options: (keys, job_id, seq, time, event, included, excluded), flavors chosen and removed: a group counts
    only while it might be in its job's flavor; without them all groups do. withdrawn: (keys, job_id, time).
    A job is pending from its first submission until no group that might be in its flavor lacks tasks, submitted or not, or until it is withdrawn.
    What changes at one time counts together. Groups of a job with the same options are a kind, which is in the flavor or not as a whole: flavors meet kinds, not
    groups, and each kind is swept over how many of its groups lack tasks, then each job over its kinds'.
    """
    job, on = [*keys, "job_id"], [*keys, "tg_id"]
    kind = [] if options is None else ["in_option", "not_in_option"]
    own = tgs.select(*job, *kind, "tg_id", "submitted")
    if "lost_time" in started.columns:
        each = F.array(F.struct(F.col("full_time").alias("time"), F.lit(-1).alias("d")), F.struct(F.col("lost_time").alias("time"), F.lit(1).alias("d")))
        by = Window.partitionBy(*on).orderBy("time")
        turns = started.select(*on, F.inline(each)).where("time is not null").groupBy(*on, "time").agg(F.sum("d").alias("d"))
        turns = turns.withColumn("lacks", 1 + F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0)) > 0)
        turns = turns.withColumn("was", F.coalesce(F.lag("lacks").over(by), F.lit(True))).where("lacks <> was").select(*on, "time", F.when(F.col("lacks"), 1).otherwise(-1).alias("d"))
    else:
        turns = started.where("full_time is not null").groupBy(*on).agg(F.min("full_time").alias("time")).withColumn("d", F.lit(-1))
    # A group lacks tasks from before all time (null) and, as far as submitted ones count, from its submission, until it turns.
    move = lambda time, lacks, ready: F.struct(F.col(time).alias("time"), lacks.cast("bigint").alias("lacks"), ready.cast("bigint").alias("ready"))
    none, d = F.lit(0), F.col("d")
    turned = F.when(F.col("time") >= F.col("submitted"), F.array(move("time", d, d))).otherwise(F.array(move("time", d, none), move("submitted", none, d)))
    if options is None and withdrawn is None and "lost_time" not in started.columns:
        return _pending_once(own, turns, interval, keys, last)
    parts = [
        own.groupBy(*job, *kind).agg(F.lit(None).cast("bigint").alias("time"), F.count("*").alias("lacks"), F.min("submitted").alias("since")),
        own.select(*job, *kind, F.col("submitted").alias("time"), F.lit(1).cast("bigint").alias("ready")),
        own.join(turns, on).select(*job, *kind, F.inline(turned)),
    ]
    if options is not None:
        parts.append(_ruled_out(own.select(*job, *kind).distinct(), options, keys))
    if withdrawn is not None:
        parts.append(withdrawn.select(*job, "time", F.col("time").alias("gone")))
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(*job)  # what follows is by job or finer
    for c in ("against", "gone"):
        dealt = dealt if c in dealt.columns else dealt.withColumn(c, F.lit(None).cast("bigint"))
    until_now = lambda w, c: F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    if kind:
        w = Window.partitionBy(*job, *kind).orderBy("time")
        held = dealt.select(*job, *kind, "time", "since", "gone", until_now(w, "against").alias("against"), *[until_now(w, c).alias(c) for c in ("lacks", "ready")])
        held = held.select(*job, *kind, "time", "since", "gone", *[F.when(F.col("against") == 0, F.col(c)).otherwise(0).alias(c) for c in ("lacks", "ready")])
        dealt = held.select(*job, "time", "since", "gone", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in ("lacks", "ready")])
    v, whole = Window.partitionBy(*job).orderBy("time"), Window.partitionBy(*job)
    jobs = dealt.select(*job, "time", *[until_now(v, c).alias(c) for c in ("lacks", "ready")], F.lead("time").over(v).alias("to"), *[F.min(c).over(whole).alias(c) for c in ("since", "gone")]).where("time >= since")
    # least() passes over nulls: an open span ends with its job, if that ends.
    jobs = jobs.withColumn("end", F.least(F.min(F.when(F.col("lacks") == 0, F.col("time"))).over(whole), "gone")).where("end is null or time < end")
    spans = jobs.select(*keys, (F.col("ready") == 0).alias("placed"), F.col("time").alias("since"), F.least("to", "end").alias("until")).where("until is null or until > since")
    return state_intervals(spans, interval, [*keys, "placed"], last)


def max_waiting_time(waits: DataFrame, interval: int) -> DataFrame:
    """(tick, waiting): at each tick from the first submission's to the last end's, now minus the oldest submission among groups (submitted, until) that still wait; 0 where none does.

    A span is cut at powers of two of the tick, so that it meets few buckets however long it is.
    """
    first, last = tick_of(F.col("submitted"), interval) / interval, tick_of(F.col("until"), interval) / interval - 1
    spans = waits.select(F.col("submitted"), first.cast("bigint").alias("a"), last.cast("bigint").alias("b")).where("a <= b")
    # Two overlapping blocks of the largest power of two that fits cover a span, as in a sparse table.
    size = F.floor(F.log2(F.col("b") - F.col("a") + 1) + 1e-9).cast("int")
    width = F.pow(F.lit(2.0), size).cast("bigint")
    blocks = spans.withColumn("k", size).withColumn("at", F.explode(F.array(F.col("a"), F.col("b") - width + 1))).groupBy("k", "at").agg(F.min("submitted").alias("oldest"))
    levels = [r.k for r in blocks.select("k").distinct().collect()]  # at most 63
    level = max(levels, default=0)
    now = blocks.where(F.col("k") == level).select("at", "oldest")
    while level > 0:
        half = 1 << (level - 1)
        down = now.select("oldest", F.explode(F.array(F.col("at"), F.col("at") + half)).alias("at"))
        level -= 1
        now = down.unionByName(blocks.where(F.col("k") == level).select("oldest", "at")).groupBy("at").agg(F.min("oldest").alias("oldest"))
    ends = waits.agg((F.min(first)).cast("bigint").alias("lo"), (F.max(last) + 1).cast("bigint").alias("hi")).where("lo <= hi")
    ticks = ends.select(F.explode(F.sequence("lo", "hi")).alias("at"))
    return ticks.join(now, "at", "left").select((F.col("at") * interval).alias("tick"), F.coalesce(F.col("at") * interval - F.col("oldest"), F.lit(0)).alias("waiting"))


def recent_latency_stats(latencies: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], last_n: int | None = 1000) -> DataFrame:
    """Least, mean (integer division), upper median and largest of the last n values of each key, or of all."""
    from tracelab.operators.histogram import upper_median_stats

    if last_n is not None:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        latencies = latencies.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last_n)
    return upper_median_stats(latencies, value, keys)


def quick_summary(counters: DataFrame, keys: Sequence[str], ratios: dict[str, Column]) -> DataFrame:
    """(keys, statistic, value): ratios of one row of counters a key, unpivoted."""
    wide = counters.select(*keys, *[x.cast("double").alias(n) for n, x in ratios.items()])
    return wide.unpivot(list(keys), list(ratios), "statistic", "value")


def timer_stats(timings: DataFrame, name: str, micros: str, order: str, last_n: int = 1000) -> DataFrame:
    """Per name: entries over 0, least, mean, upper median and largest of the last n, total ms."""
    good = timings.where(F.col(micros) > 0)
    recent = recent_latency_stats(good, [name], micros, [order], last_n)
    return recent.join(good.groupBy(name).agg(F.count("*").alias("entries"), F.floor(F.sum(micros) / 1000).cast("bigint").alias("total_ms")), name)


def total_increase(reports: DataFrame, name: str, total: str, order: str) -> DataFrame:
    """Growth of a timer's total since its report before."""
    return reports.withColumn("increase", F.col(total) - F.coalesce(F.lag(total).over(Window.partitionBy(name).orderBy(order)), F.lit(0)))


def round_timings(long: DataFrame, keys: Sequence[str], name: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """One row a round with a column for each kind of measurement, -1 where there is none."""
    wide = long.groupBy(*keys).pivot(name, list(kinds)).agg(F.max(value))
    return wide.select(*keys, *[F.coalesce(k, F.lit(-1)).alias(k) for k in kinds])


def recent_speed(progress: DataFrame, keys: Sequence[str], sim: str, wall_us: str, end: int, last_n: int = 10) -> DataFrame:
    """(keys, speed, remaining_us): upper median of wall µs per simulated ms over the last n reports that moved, and what is left at that speed."""
    w = Window.partitionBy(*keys).orderBy(wall_us)
    moved = progress.withColumn("_s", F.col(sim) - F.lag(sim).over(w)).withColumn("_u", F.col(wall_us) - F.lag(wall_us).over(w)).where("_s > 0 and _u > 0")
    moved = moved.withColumn("speed", F.col("_u") / F.col("_s")).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(wall_us).desc()))).where(F.col("_k") <= last_n)
    ranked = moved.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("speed"))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    speed = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("speed"))).alias("speed"))
    at = progress.groupBy(*keys).agg(F.max(sim).alias("_at"))
    return speed.join(at, list(keys)).select(*keys, "speed", (F.col("speed") * (F.lit(end) - F.col("_at"))).alias("remaining_us"))


def preemption_counts(events: DataFrame, job_events: DataFrame | None = None) -> DataFrame:
    """(job_id, preemptions, last_preemption, preempted_tasks): distinct times at which a job lost running allocations, the last one, and the tasks.

    job_events: (job_id, time, event). A withdraw preempts what runs then, and counts as tasks all that the job was ever given until then, as those
    who report it do; it is the last preemption, whether anything ran or not. `withdrawn_tasks` is what did run: allocations claimed by then and not
    ended before, which the difference of claims and ends by job tells without joining them in pairs.
    """
    taken = events.where("event = 'preempt'").select("job_id", "time", "num_tasks")
    if job_events is None:
        return taken.groupBy("job_id").agg(F.count_distinct("time").alias("preemptions"), F.max("time").alias("last_preemption"), F.sum("num_tasks").alias("preempted_tasks"))
    ends = job_events.where("event = 'withdraw'").groupBy("job_id").agg(F.min("time").alias("withdrawn"))
    rows = events.select("job_id", "time", "event", "num_tasks").join(ends, "job_id", "left")
    on_time = F.col("withdrawn").isNull() | (F.col("time") <= F.col("withdrawn"))
    own = rows.where(on_time)
    claim, preempt = F.col("event") == "claim", F.col("event") == "preempt"
    add = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint")
    sums = own.groupBy("job_id").agg(
        F.collect_set(F.when(preempt, F.col("time"))).alias("times"), F.max(F.when(preempt, F.col("time"))).alias("last"), add(preempt, F.col("num_tasks")).alias("tasks"), add(claim, F.col("num_tasks")).alias("given"), (add(claim, F.col("num_tasks")) - add(~claim, F.col("num_tasks"))).alias("running"),
    )
    both = sums.join(ends, "job_id", "full")
    alive = F.col("withdrawn").isNotNull() & (F.coalesce("running", F.lit(0)) > 0)
    times = F.coalesce("times", F.array().cast("array<bigint>"))
    out = both.select(
        "job_id", F.size(F.when(alive, F.array_union(times, F.array("withdrawn"))).otherwise(times)).cast("bigint").alias("preemptions"), F.coalesce("withdrawn", "last").alias("last_preemption"),
        (F.coalesce("tasks", F.lit(0)) + F.when(F.col("withdrawn").isNotNull(), F.coalesce("given", F.lit(0))).otherwise(0)).alias("preempted_tasks"), F.when(alive, F.col("running")).otherwise(0).alias("withdrawn_tasks"),
    )
    return out.where("last_preemption is not null")
