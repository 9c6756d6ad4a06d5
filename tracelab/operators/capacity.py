"""How many tasks of a group fit on machines as they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators.switches import _plus, _units

#: Fixed value: tasks of a group that needs nothing, where no other limit holds.
UNLIMITED = 2_147_483_647
_SHAPE = ("demand", "is_switch", "properties")


def fitting_tasks(max_active: int | None = None, shared: Mapping[str, Sequence[int]] | None = None, mode: str = "never") -> Column:
    """Of a row with a group's shape (demand, is_switch, properties) and a machine's state (free, supported, active): tasks that fit, beside no other limit.

    The least of free / demand, rounded down, over the dimensions that the group needs. A switch must support all properties, and have them active or
    slots for them; what they need themselves (switches.py) comes on top, by mode, once for those that aren't active or for each task.
    """
    demand = F.col("demand").cast("array<bigint>")
    missing = F.array_except("properties", "active")
    if shared and mode in ("once", "foreach"):
        units, none = _units(shared), F.transform(demand, lambda x: x * 0)
        own = F.aggregate(missing if mode == "once" else F.col("properties"), none, lambda acc, p: _plus(acc, F.coalesce(F.try_element_at(units, p), none)))
        demand = F.when(F.col("is_switch"), _plus(demand, own)).otherwise(demand)
    need = F.filter(F.arrays_zip(demand.alias("demand"), F.col("free")), lambda x: x["demand"] > 0)
    most = F.coalesce(F.array_min(F.transform(need, lambda x: F.floor(x["free"] / x["demand"]))), F.lit(UNLIMITED))
    slots = (F.size(missing) == 0) | (F.size(F.array_union("properties", "active")) <= (UNLIMITED if max_active is None else max_active))
    fits = ~F.col("is_switch") | ((F.size(F.array_except("properties", "supported")) == 0) & slots)
    return F.when(fits, F.greatest(F.lit(0), most)).otherwise(0).cast("bigint")


def capacity_fit(
    tgs: DataFrame, machines: DataFrame, max_active: int | None = None, held: DataFrame | None = None, shared: Mapping[str, Sequence[int]] | None = None, mode: str = "never", ignore_running: bool = False
) -> DataFrame:
    """(tg_id, machines, tasks): on how many machines at least a task of a group fits, and how many fit on all.

    tgs: (tg_id, demand, is_switch, properties), arrays, and if they have them, co_locate (default: true) and not_started (default: no limit): a machine takes at most the tasks
    that haven't started, and one of a group that isn't co-located. machines: (machine_id, is_switch, free, supported, active). held: (tg_id, machine_id), where groups that
    aren't co-located run, takes these machines from them. ignore_running looks away from what has started: neither not_started nor held count.
    Distinct shapes of groups meet distinct states of machines, with counts; a group then reads its shape's histogram of tasks. Machines that it holds are looked up one by one and
    taken off.
    """
    for name, default in (("co_locate", F.lit(True)), ("not_started", F.lit(None).cast("bigint"))):
        if name not in tgs.columns:
            tgs = tgs.withColumn(name, default)
    tgs = tgs.select("tg_id", *_SHAPE, "co_locate", F.col("not_started").cast("bigint"))
    if ignore_running:
        tgs = tgs.withColumn("not_started", F.lit(None).cast("bigint"))
    limit = F.least(F.coalesce("not_started", F.lit(UNLIMITED).cast("bigint")), F.when(F.col("co_locate"), F.lit(UNLIMITED)).otherwise(1))
    k = fitting_tasks(max_active, shared, mode)
    states = machines.groupBy(F.col("is_switch").alias("s"), "free", "supported", "active").agg(F.count("*").alias("n"))
    shapes = tgs.select(*_SHAPE).distinct()
    met = shapes.join(states, F.col("is_switch") == F.col("s")).withColumn("k", k).where("k > 0")
    counts = met.groupBy(*_SHAPE, "k").agg(F.sum("n").alias("n")).groupBy(*_SHAPE).agg(F.collect_list(F.struct("k", "n")).alias("counts"))  # a shape has as many as tasks fit on a machine
    sums = lambda f: F.coalesce(F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, x: acc + f(x)), F.lit(0).cast("bigint"))
    rows = tgs.withColumn("limit", limit).join(counts, list(_SHAPE), "left")
    out = rows.select("tg_id", "limit", F.when(F.col("limit") > 0, sums(lambda x: x["n"])).otherwise(0).alias("machines"), sums(lambda x: F.least(x["k"], F.col("limit")) * x["n"]).alias("tasks"))
    if held is None or ignore_running:
        return out.select("tg_id", "machines", "tasks")
    own = held.select("tg_id", "machine_id").distinct().join(tgs.where(~F.col("co_locate")).withColumn("limit", limit).where("limit > 0"), "tg_id")
    state = machines.select("machine_id", F.col("is_switch").alias("s"), "free", "supported", "active")
    taken = own.join(state, "machine_id").where("is_switch = s").withColumn("k", k).where("k > 0").groupBy("tg_id").agg(F.count("*").alias("lost"))
    lost = F.coalesce("lost", F.lit(0))
    return out.join(taken, "tg_id", "left").select("tg_id", (F.col("machines") - lost).alias("machines"), (F.col("tasks") - lost).alias("tasks"))
