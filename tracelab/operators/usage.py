"""Use of resources over time, rebuilt from an allocation event log.

A log row is (seq, time, event claim|release|preempt, alloc_id, job_id, tg_id, machine_id, num_tasks, ...); seq is total.
Running sums are per machine and dimension; cell-wide series are summed by tick before they are accumulated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.sources.scratch import materialize


def sign() -> Column:
    return F.when(F.col("event") == "claim", 1).otherwise(-1)


def _so_far(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)


def check_event_log(events: DataFrame, submits: DataFrame | None = None) -> DataFrame:
    """Violations (alloc_id, rule). submits: (tg_id, submitted, co_locate), for rules that need them."""
    seen = events.groupBy("alloc_id").agg(
        F.count_if(F.col("event") == "claim").alias("claims"),
        F.count_if(F.col("event") != "claim").alias("ends"),
        F.min("num_tasks").alias("tasks"),
        F.min(F.when(F.col("event") == "claim", F.col("time"))).alias("claimed"),
        F.min(F.when(F.col("event") != "claim", F.col("time"))).alias("ended"),
        F.min("tg_id").alias("tg_id"),
    )
    rule = F.when(F.col("claims") != 1, "not claimed once").when(F.col("ends") > 1, "ended twice").when(F.col("tasks") <= 0, "no tasks").when(F.col("ended") < F.col("claimed"), "ended before its claim")
    if submits is not None:
        seen = seen.join(submits, "tg_id", "left")
        rule = rule.when(F.col("claimed") < F.col("submitted"), "before submission").when(~F.col("co_locate") & (F.col("tasks") > 1), "several tasks")
    return seen.select("alloc_id", rule.alias("rule")).where("rule is not null")


def demand_deltas(events: DataFrame, demand: Sequence[str]) -> DataFrame:
    """(seq, time, machine_id, dim, delta): tasks times demand, negative at the end. demand names a column for each dimension."""
    each = F.posexplode(F.array(*[F.col(c) for c in demand])).alias("dim", "d")
    return events.select("seq", "time", "machine_id", (sign() * F.col("num_tasks")).alias("n"), each).select("seq", "time", "machine_id", "dim", (F.col("n") * F.col("d")).alias("delta"))


def server_usage(events: DataFrame, demand: Sequence[str], capacity: DataFrame) -> DataFrame:
    """Free units of each machine and dimension after each event. capacity: (machine_id, dim, capacity)."""
    used = demand_deltas(events, demand).withColumn("used", F.sum("delta").over(_so_far("machine_id", "dim")))
    return used.join(capacity, ["machine_id", "dim"]).select("seq", "time", "machine_id", "dim", "used", (F.col("capacity") - F.col("used")).alias("free"))


def active_properties(events: DataFrame, prop: str = "property") -> DataFrame:
    """Toggles (seq, time, machine_id, property, active): where the number of running allocations that use a property leaves or reaches 0."""
    run = events.select("seq", "time", "machine_id", prop, sign().alias("step")).withColumn("n", F.sum("step").over(_so_far("machine_id", prop)))
    toggles = run.where(((F.col("n") == 1) & (F.col("step") == 1)) | ((F.col("n") == 0) & (F.col("step") == -1)))
    return toggles.select("seq", "time", "machine_id", F.col(prop).alias("property"), (F.col("n") > 0).alias("active"))


def shared_demand_usage(events: DataFrame, own: str, shared: DataFrame, mode: str, prop: str = "property") -> DataFrame:
    """Reserved and real units of each machine after each event: a task's own demand and, by mode, its property's.

    once: a property's demand counts while it is active; foreach: it is reserved for every task but really used once;
    never (or deactivated): it isn't counted. own names a column, shared is (property, demand), of bounded size.
    """
    mode = {"deactivated": "never"}.get(mode, mode)
    if mode not in ("once", "foreach", "never"):
        raise ValueError(mode)
    rows = events.join(shared.withColumnRenamed("property", prop), prop, "left").withColumn("demand", F.coalesce("demand", F.lit(0)))
    rows = rows.withColumn("step", sign()).withColumn("n", F.sum("step").over(_so_far("machine_id", prop)))
    toggle = F.when((F.col("n") == 1) & (F.col("step") == 1), 1).when((F.col("n") == 0) & (F.col("step") == -1), -1).otherwise(0)
    base = F.col("step") * F.col("num_tasks") * F.col(own)
    once = toggle * F.col("demand") if mode != "never" else F.lit(0)
    reserve = F.col("step") * F.col("num_tasks") * F.col("demand") if mode == "foreach" else once
    w = _so_far("machine_id")
    return rows.withColumn("r", base + reserve).withColumn("u", base + once).select("seq", "time", "machine_id", F.sum("r").over(w).alias("reserved"), F.sum("u").over(w).alias("used"))


def tick_of(time: Column, interval: int) -> Column:
    """The first tick at or after a time."""
    return F.ceil(time / interval).cast("bigint") * interval


def _ticks(deltas: DataFrame, keys: Sequence[str], interval: int, last: int | None = None) -> DataFrame:
    """Every tick of every key from the first to the last of all, or to `last` if that is later."""
    ends = F.broadcast(deltas.agg(F.min("tick").alias("lo"), F.greatest(F.max("tick"), F.lit(last).cast("bigint")).alias("hi")))  # one row
    return deltas.select(*keys).distinct().crossJoin(ends).select(*keys, F.explode(F.sequence("lo", "hi", F.lit(interval).cast("bigint"))).alias("tick"))


def running_by_tick(deltas: DataFrame, keys: Sequence[str], values: Sequence[str], interval: int, last: int | None = None) -> DataFrame:
    """Running sums of values of (keys, tick) rows at each tick, dense, up to the last change or to the tick `last` if that is later."""
    summed = materialize(deltas.groupBy(*keys, "tick").agg(*[F.sum(v).alias(v) for v in values]), "ticks")  # met three times below
    dense = _ticks(summed, keys, interval, last).join(summed, [*keys, "tick"], "left")
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(*keys, "tick", *[F.sum(F.coalesce(v, F.lit(0))).over(w).alias(v) for v in values])


def cell_utilization(events: DataFrame, demand: Sequence[str], capacity: DataFrame, interval: int) -> DataFrame:
    """(dim, tick, used, utilization): claimed units over capacity of all machines, at each tick. Events at a tick count."""
    deltas = demand_deltas(events, demand).select("dim", tick_of(F.col("time"), interval).alias("tick"), F.col("delta").alias("used"))
    total = capacity.groupBy("dim").agg(F.sum("capacity").alias("total"))
    return running_by_tick(deltas, ["dim"], ["used"], interval).join(F.broadcast(total), "dim").select("dim", "tick", "used", F.try_divide("used", "total").alias("utilization"))


def active_inc_load(toggles: DataFrame, switches: int, max_active: int, interval: int) -> DataFrame:
    """(tick, active, in_use, mean_active, share): properties active on all switches, switches with any, properties per switch, and of the most that may be."""
    step = F.when(F.col("active"), 1).otherwise(-1)
    after = toggles.withColumn("n", F.sum(step).over(_so_far("machine_id")))
    turned = F.when(F.col("active") & (F.col("n") == 1), 1).when(~F.col("active") & (F.col("n") == 0), -1).otherwise(0)
    deltas = after.select(F.lit(0).alias("k"), tick_of(F.col("time"), interval).alias("tick"), step.cast("bigint").alias("active"), turned.cast("bigint").alias("in_use"))
    return running_by_tick(deltas, ["k"], ["active", "in_use"], interval).select("tick", "active", "in_use", (F.col("active") / switches).alias("mean_active"), (F.col("active") / (switches * max_active)).alias("share"))


def property_occupancy(toggles: DataFrame, properties: Sequence[str], switches: int, max_active: int, interval: int) -> DataFrame:
    """(property, tick, blocked, share): switches where the property is active, or as many others are as may be."""
    step = F.when(F.col("active"), 1).otherwise(-1)
    after = toggles.withColumn("n", F.sum(step).over(_so_far("machine_id")))
    own = F.when(F.col("property") == F.col("p"), step)
    each = after.withColumn("p", F.explode(F.array(*[F.lit(p) for p in properties])))
    w = Window.partitionBy("machine_id", "p").orderBy("time", "seq")
    each = each.withColumn("on", F.sum(F.coalesce(own, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    each = each.withColumn("taken", (F.col("on") | (F.col("n") >= max_active)).cast("int"))
    moved = each.withColumn("d", (F.col("taken") - F.coalesce(F.lag("taken").over(w), F.lit(0))).cast("bigint")).where("d <> 0")
    deltas = moved.select(F.col("p").alias("property"), tick_of(F.col("time"), interval).alias("tick"), F.col("d").alias("blocked"))
    return running_by_tick(deltas, ["property"], ["blocked"], interval).withColumn("share", F.col("blocked") / switches)


def total_capacity(capacity: DataFrame, free: DataFrame) -> DataFrame:
    """(dim, capacity, free, all_free) over all machines. free: the last free units of each (machine_id, dim) that had events."""
    both = capacity.join(free.select("machine_id", "dim", "free"), ["machine_id", "dim"], "left").withColumn("free", F.coalesce("free", "capacity"))
    return both.groupBy("dim").agg(F.sum("capacity").alias("capacity"), F.sum("free").alias("free"), F.bool_and(F.col("free") == F.col("capacity")).alias("all_free"))
