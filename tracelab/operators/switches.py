"""Use of switches by properties and dimensions, from the allocation event log of the switches.

Events are those of usage.py with `properties`, an array of names: all that an allocation's group asks for. A property is active
on a switch while an allocation there uses it; what it needs itself comes on top of the groups' own demands, by mode:
`once` while it is active, `foreach` reserved for every task but used once, `never` (or `deactivated`) not at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.operators.usage import running_by_tick, sign, tick_of

#: Kinds of columns of the load table, in their order.
KINDS = {"utilization": "UtilizationSwitch", "reserved_share": "ReservedSwitch", "total_share": "TotalSwitch", "blocked_by_others": "BlockedByOthersSwitch"}
#: Properties whose activity one number holds.
_BITS = 60


def _units(values: Mapping[str, Sequence[int]]) -> Column:
    return F.create_map(*[x for p, v in values.items() for x in (F.lit(str(p)), F.array(*[F.lit(int(u)).cast("bigint") for u in v]))])


def _zeros(dims: int) -> Column:
    return F.array(*[F.lit(0).cast("bigint")] * dims)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _times(n: Column, a: Column) -> Column:
    return F.transform(a, lambda x: n * x)


def switch_demands(events: DataFrame, own: Sequence[str], shared: Mapping[str, Sequence[int]] | None = None, mode: str = "never") -> DataFrame:
    """(machine_id, time, seq, step, properties, turned, reserve, real), a row for each event.

    own names a column for each dimension; shared gives what a property itself needs, by dimension (none if it isn't there). turned are the
    properties that the event starts or ends; reserve and real are the units by dimension that it takes, negative at an end. A null or
    empty array of properties is none. Rows are dealt by switch once; whatever follows by switch needs no other shuffle.
    """
    mode = {"deactivated": "never"}.get(mode, mode)
    if mode not in ("once", "foreach", "never"):
        raise ValueError(mode)
    dims = len(own)
    names = F.array_distinct(F.array_compact(F.coalesce(F.col("properties").cast("array<string>"), F.array().cast("array<string>"))))
    base = events.select("machine_id", "time", "seq", sign().alias("step"), F.col("num_tasks").cast("bigint").alias("tasks"), names.alias("properties"), F.array(*[F.col(c).cast("bigint") for c in own]).alias("own"))
    each = base.repartition("machine_id").withColumn("p", F.explode_outer("properties"))
    running = F.sum("step").over(Window.partitionBy("machine_id", "p").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("n", running)
    turns = F.col("p").isNotNull() & (((F.col("n") == 1) & (F.col("step") == 1)) | ((F.col("n") == 0) & (F.col("step") == -1)))
    kept = [F.first(c).alias(c) for c in ("step", "tasks", "properties", "own")]
    rows = each.groupBy("machine_id", "time", "seq").agg(*kept, F.array_sort(F.collect_set(F.when(turns, F.col("p")))).alias("turned"))
    step, tasks = F.col("step"), F.col("step") * F.col("tasks")
    reserve = real = _times(tasks, F.col("own"))
    if shared and mode != "never":
        units = _units(shared)
        total = lambda names: F.aggregate(names, _zeros(dims), lambda acc, p: _plus(acc, F.coalesce(F.try_element_at(units, p), _zeros(dims))))
        once = _times(step, total(F.col("turned")))
        reserve, real = _plus(reserve, _times(tasks, total(F.col("properties"))) if mode == "foreach" else once), _plus(real, once)
    return rows.select("machine_id", "time", "seq", "step", "properties", "turned", reserve.alias("reserve"), real.alias("real"))


def _running(values: Column, dims: int) -> Column:
    w = Window.partitionBy("machine_id").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return F.array(*[F.sum(values[d]).over(w) for d in range(dims)])


def switch_usage(demands: DataFrame, dims: int) -> DataFrame:
    """Reserved and real units of a switch by dimension after each event."""
    return demands.select("machine_id", "time", "seq", _running(F.col("reserve"), dims).alias("reserved"), _running(F.col("real"), dims).alias("used"))


def _total_bits(bits: Column) -> Column:
    none = F.lit(0).cast("bigint")
    return F.aggregate("turned", none, lambda acc, p: acc + F.coalesce(F.try_element_at(bits, p), none))


def _active(properties: Sequence[str]) -> Column:
    """The properties that are active on a switch after an event: each is a bit of a running sum, as its starts and ends alternate."""
    w = Window.partitionBy("machine_id").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = []
    for k in range(0, len(properties), _BITS):
        some = properties[k : k + _BITS]
        bits = F.create_map(*[x for b, p in enumerate(some) for x in (F.lit(p), F.lit(1 << b).cast("bigint"))])
        mask = F.sum(F.col("step") * _total_bits(bits)).over(w)
        found += [F.when(mask.bitwiseAND(F.lit(1 << b).cast("bigint")) != 0, F.lit(p)) for b, p in enumerate(some)]
    return F.array_compact(F.array(*found))


def load_deltas(demands: DataFrame, capacity: DataFrame, dims: int, interval: int, properties: Sequence[str]) -> DataFrame:
    """(property, dim, tick, used, reserved, total, blocked): what each event changes, before it is summed. capacity: (machine_id, capacity), an array.

    An event moves the used and reserved units of its own properties; it moves what is blocked of the others that are active on its switch then.
    A property that starts there gains the switch's capacity, blocked as far as it is reserved by then; one that ends loses them again.
    A sweep over each switch's events in order gives the active ones and the reserved units, without pairs of events and properties that aren't active.
    """
    names = [str(p) for p in properties]
    swept = demands.withColumns({"active": _active(names) if names else F.array().cast("array<string>"), "after": _running(F.col("reserve"), dims)})
    swept = swept.join(capacity.select("machine_id", "capacity"), "machine_id")
    zeros, none = _zeros(dims), F.col("step") * 0
    before = F.zip_with("after", "reserve", lambda a, r: a - r)
    others = F.when(F.col("step") > 0, before).otherwise(F.col("after"))  # what is reserved without this event's allocation
    entry = lambda p, **at: F.struct(p.alias("property"), *[at.get(c, zeros).alias(c) for c in ("used", "reserved", "total", "blocked")])
    own = F.transform("properties", lambda p: entry(p, used=F.col("real"), reserved=F.col("reserve")))
    turned = F.transform("turned", lambda p: entry(p, total=_times(F.col("step"), F.col("capacity")), blocked=_times(F.col("step"), others)))
    beside = F.transform(F.array_except("active", "properties"), lambda p: entry(p, blocked=F.col("reserve")))
    entries = swept.select(tick_of(F.col("time"), interval).alias("tick"), F.inline(F.concat(own, turned, beside)))
    each = entries.select("property", "tick", F.posexplode(F.arrays_zip("used", "reserved", "total", "blocked")).alias("dim", "x"))
    return each.select("property", "dim", "tick", "x.used", "x.reserved", "x.total", "x.blocked")


def inc_load(demands: DataFrame, capacity: DataFrame, dims: int, interval: int, properties: Sequence[str]) -> DataFrame:
    """(property, dim, tick, used, reserved, total, blocked) and their ratios, at each tick, events at it included.

    utilization, reserved_share and blocked_by_others are of the capacity of switches where the property is active; total_share is that
    capacity's share of all switches'. All are 0 where the property is active nowhere. properties: those that may occur; others are left out.
    """
    known = load_deltas(demands, capacity, dims, interval, properties).where(F.col("property").isin([str(p) for p in properties]))
    rows = running_by_tick(known, ["property", "dim"], ["used", "reserved", "total", "blocked"], interval)
    all_ = capacity.select(F.posexplode("capacity").alias("dim", "c")).groupBy("dim").agg(F.sum("c").alias("capacity"))  # a row for each dimension
    ratio = lambda a, b: F.when(F.col("total") == 0, 0.0).otherwise(F.try_divide(F.col(a), F.col(b)))
    return rows.join(F.broadcast(all_), "dim").select(
        "property", "dim", "tick", "used", "reserved", "total", "blocked",
        ratio("used", "total").alias("utilization"), ratio("reserved", "total").alias("reserved_share"), ratio("total", "capacity").alias("total_share"), ratio("blocked", "total").alias("blocked_by_others"),
    )


def load_table(load: DataFrame, properties: Sequence[str], dims: int) -> DataFrame:
    """inc_load's ratios as the load file has them: a row for each tick, columns by property, dimension and kind; 0 for what never occurs."""
    series = [f"{p}:{d}" for p in properties for d in range(dims)]
    wide = load.withColumn("series", F.concat_ws(":", "property", "dim")).groupBy("tick").pivot("series", series).agg(*[F.first(k).alias(k) for k in KINDS])
    columns = [F.coalesce(F.col(f"`{p}:{d}_{k}`"), F.lit(0.0)).alias(f"{name}_Prop{p}_Dim{d}") for p in properties for d in range(dims) for k, name in KINDS.items()]
    return wide.select(F.col("tick").alias("Time"), *columns)


def property_load(load: DataFrame) -> DataFrame:
    """(property, dim, tick, load, reserved_load): what is used, or reserved, by the property and others, of the capacity of switches where it is active."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c) + F.col("blocked"), "total"), F.lit(0.0))
    return load.select("property", "dim", "tick", share("used").alias("load"), share("reserved").alias("reserved_load"))


def cell_table(servers: DataFrame, server_own: Sequence[str], server_capacity: DataFrame, demands: DataFrame, capacity: DataFrame, dims: int, interval: int, max_active: int) -> DataFrame:
    """The cell file: at each tick the claimed share of switches (as reserved, as used) and servers by dimension, and how many properties a switch has active, of the most that may be.

    servers: the events of servers, whose demands are the columns server_own; capacities are (machine_id, capacity), arrays. Dimensions without capacity are null.
    """
    claims = lambda values, kind, dims: [F.struct(F.lit(f"{kind}{d}").alias("series"), values[d].alias("units")) for d in range(dims)]
    tick = tick_of(F.col("time"), interval).alias("tick")
    server = F.transform(F.array(*[F.col(c).cast("bigint") for c in server_own]), lambda x: sign() * F.col("num_tasks") * x)
    of_servers = servers.select(tick, F.inline(F.array(*claims(server, "UtilizationServersDim", len(server_own)))))
    inp = F.struct(F.lit("UtilizationSwitchINP").alias("series"), (F.col("step") * F.size("turned")).cast("bigint").alias("units"))
    of_switches = demands.select(tick, F.inline(F.array(inp, *claims(F.col("reserve"), "UtilizationSwitchesDim", dims), *claims(F.col("real"), "ActualUtilizationSwitchesDim", dims))))
    rows = running_by_tick(of_servers.unionByName(of_switches), ["series"], ["units"], interval)
    sums = lambda df, kind: df.select(F.posexplode("capacity").alias("d", "c")).groupBy(F.concat(F.lit(kind), "d").alias("series")).agg(F.sum("c").alias("most"))
    most = sums(server_capacity, "UtilizationServersDim").unionByName(sums(capacity, "UtilizationSwitchesDim")).unionByName(sums(capacity, "ActualUtilizationSwitchesDim"))
    most = most.unionByName(capacity.agg((F.count("*") * max_active).alias("most")).select(F.lit("UtilizationSwitchINP").alias("series"), "most"))
    columns = ["UtilizationSwitchINP", *[f"{k}{d}" for k in ("UtilizationSwitchesDim", "ActualUtilizationSwitchesDim") for d in range(dims)], *[f"UtilizationServersDim{d}" for d in range(len(server_own))]]
    share = rows.join(F.broadcast(most), "series").select("tick", "series", F.try_divide("units", "most").alias("share"))  # a row for each column of the file
    return share.groupBy(F.col("tick").alias("Time")).pivot("series", columns).agg(F.first("share")).select("Time", *columns)
