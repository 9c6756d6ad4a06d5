"""Topology and locality: racks, reach, hop counts, detours. Iterations run over levels or the diameter, each staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.sources.scratch import materialize


def server_tor(links: DataFrame) -> DataFrame:
    """(server, tor): the rack switch of each server; a server with another number of them than one is left out (see check_topology)."""
    up = links.where(~F.col("src_is_switch") & F.col("dst_is_switch")).groupBy("src").agg(F.min("dst").alias("tor"), F.count_distinct("dst").alias("n"))
    return up.where("n = 1").select(F.col("src").alias("server"), "tor")


def switch_parents(links: DataFrame) -> DataFrame:
    return links.where("src_is_switch and dst_is_switch").select(F.col("src").alias("switch"), F.col("dst").alias("parent")).distinct()


def rack_members(links: DataFrame) -> DataFrame:
    return server_tor(links).select(F.col("tor").alias("switch"), "server")


def reachable_servers(links: DataFrame) -> DataFrame:
    """(switch, server): servers below each switch, level by level."""
    parents = switch_parents(links)
    level = materialize(rack_members(links), "reach")
    out = level
    while not level.isEmpty():
        level = materialize(level.join(parents, "switch").select(F.col("parent").alias("switch"), "server").distinct(), "reach")
        out = out.unionByName(level)
    return out.distinct()


def switch_distance(links: DataFrame) -> DataFrame:
    """(a, b, hops) of all pairs of switches that are connected, a = b included: shortest paths grow by a hop a round, for as many as the diameter."""
    up = switch_parents(links)
    step = materialize(up.select(F.col("switch").alias("b"), F.col("parent").alias("c")).unionByName(up.select(F.col("parent").alias("b"), F.col("switch").alias("c"))).distinct(), "hops")
    known = step.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("hops"))
    known = front = materialize(known, "hops")
    hops = 0
    while not front.isEmpty():
        hops += 1
        reached = front.select("a", "b").join(step, "b").select("a", F.col("c").alias("b")).distinct()
        front = materialize(reached.join(known.select("a", "b"), ["a", "b"], "left_anti").withColumn("hops", F.lit(hops)), "hops")
        known = known.unionByName(front)
    return known


def neighbours(links: DataFrame) -> DataFrame:
    """(switch, next), both ways."""
    up = switch_parents(links)
    return up.select("switch", F.col("parent").alias("next")).unionByName(up.select(F.col("parent").alias("switch"), F.col("switch").alias("next"))).distinct()


def switch_classes(links: DataFrame) -> DataFrame:
    """(switch, class): switches with the same neighbours, named by the least of them. They are as far from all others as each other, and two hops apart."""
    near = neighbours(links).groupBy("switch").agg(F.sort_array(F.collect_set("next")).alias("near"))  # as many as a switch has links
    lone = rack_members(links).select("switch").distinct().join(near, "switch", "left_anti").select("switch", F.col("switch").alias("class"))
    return near.groupBy("near").agg(F.collect_list("switch").alias("all")).select(F.explode("all").alias("switch"), F.array_min("all").alias("class")).unionByName(lone)


def switch_hops(pairs: DataFrame, links: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(a, b, hops) of the given pairs of switches that are connected; 0 to itself.

    Labels of a switch are those within r hops of it, by class: two switches are at most 2r apart if they share one, and the nearest shared gives
    the distance. r grows for as long as a pair has none in common, for the switches of such pairs alone.
    """
    classes = materialize(switch_classes(links) if classes is None else classes, "classes")
    name = lambda side: classes.select(F.col("switch").alias(side), F.col("class").alias(f"c{side}"))
    named = materialize(pairs.select("a", "b").distinct().join(name("a"), "a").join(name("b"), "b"), "pairs")
    step = neighbours(links).join(classes, "switch").select(F.col("class").alias("at"), "next")
    step = materialize(step.join(classes.select(F.col("switch").alias("next"), F.col("class").alias("to")), "next").select("at", "to").distinct(), "steps")
    apart = materialize(named.where("ca <> cb").select("ca", "cb").distinct(), "apart")
    ends = apart.select(F.col("ca").alias("of")).unionByName(apart.select(F.col("cb").alias("of"))).distinct()
    label = front = materialize(ends.select("of", F.col("of").alias("at"), F.lit(0).alias("r")), "labels")
    found, radius = apart.select("ca", "cb", F.lit(0).alias("h")).limit(0), 0
    while not apart.isEmpty():
        radius += 1
        reached = front.join(step, "at").select("of", F.col("to").alias("at")).distinct()
        front = materialize(reached.join(label, ["of", "at"], "left_anti").withColumn("r", F.lit(radius)), "labels")
        if front.isEmpty():
            break  # the rest isn't connected
        label = label.unionByName(front)
        side = lambda end, r: label.select(F.col("of").alias(end), "at", F.col("r").alias(r))
        met = materialize(apart.join(side("ca", "r1"), "ca").join(side("cb", "r2"), ["cb", "at"]).groupBy("ca", "cb").agg(F.min(F.col("r1") + F.col("r2")).alias("h")), "met")
        found = found.unionByName(met)
        apart = materialize(apart.join(met, ["ca", "cb"], "left_anti"), "apart")
        left = apart.select(F.col("ca").alias("of")).unionByName(apart.select(F.col("cb").alias("of"))).distinct()
        label, front = label.join(left, "of", "left_semi"), front.join(left, "of", "left_semi")
    one = named.where("ca = cb").select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(2).alias("hops"))
    return one.unionByName(named.join(found, ["ca", "cb"]).select("a", "b", F.col("h").alias("hops")))


def server_distance(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs (a, b) of servers with hops: by their racks, one hop to each; 0 to itself. Pairs are never made here."""
    tor = server_tor(links)
    ends = pairs.join(tor.select(F.col("server").alias("a"), F.col("tor").alias("ta")), "a").join(tor.select(F.col("server").alias("b"), F.col("tor").alias("tb")), "b")
    far = switch_hops(ends.select(F.col("ta").alias("a"), F.col("tb").alias("b")), links).select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("hops").alias("h"))
    return ends.join(far, ["ta", "tb"]).select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("h") + 2).alias("hops"))


def involved_racks(allocs: DataFrame, links: DataFrame) -> DataFrame:
    """(tg_id, racks): distinct racks of a server group, distinct switches of a switch group. allocs: (tg_id, machine_id, is_switch)."""
    at = _switch_of(allocs, links)
    return at.groupBy("tg_id").agg(F.count_distinct("switch").alias("racks"))


def _switch_of(allocs: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (tg_id, is_switch, switch): the switch itself or a server's rack."""
    tor = server_tor(links)
    here = allocs.select("tg_id", "machine_id", "is_switch").distinct()
    served = here.where(~F.col("is_switch")).join(tor, F.col("machine_id") == F.col("server")).select("tg_id", "is_switch", F.col("tor").alias("switch"))
    return served.unionByName(here.where("is_switch").select("tg_id", "is_switch", F.col("machine_id").alias("switch"))).distinct()


def connected_machines(allocs: DataFrame, edges: DataFrame) -> DataFrame:
    """(tg_id, machine_id, is_switch): machines of a group's successors. edges: (src_tg, dst_tg)."""
    there = allocs.select(F.col("tg_id").alias("dst_tg"), "machine_id", "is_switch").distinct()
    return edges.join(there, "dst_tg").select(F.col("src_tg").alias("tg_id"), "machine_id", "is_switch").distinct()


def max_diameter(allocs: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(tg_id, max_diameter): the most hops from a group's switches or racks to other switches of its successors, or to other racks and one more to a server there; one more from a server group.

    -1 without successors; 0, or 1 from a server group, where they have nothing elsewhere. Both sides are reduced to classes of switches before they meet.
    """
    classes = materialize(switch_classes(links), "classes")
    span = lambda df, *keys: df.join(classes, "switch").groupBy("tg_id", "class", *keys).agg(F.min("switch").alias("lo"), F.max("switch").alias("hi"))
    own = span(_switch_of(allocs, links).select("tg_id", "switch")).select("tg_id", F.col("class").alias("ca"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    far = _switch_of(connected_machines(allocs, edges), links).select("tg_id", "switch", F.when(F.col("is_switch"), 0).otherwise(1).alias("last"))
    both = own.join(span(far, "last").withColumnRenamed("class", "cb"), "tg_id")
    # Within a class there is a pair unless both sides are the same one switch.
    both = both.where((F.col("ca") != F.col("cb")) | ~((F.col("lo1") == F.col("hi1")) & (F.col("lo") == F.col("hi")) & (F.col("lo1") == F.col("lo"))))
    met = both.select("tg_id", "ca", "cb", "last")
    hops = switch_hops(met.select(F.col("ca").alias("a"), F.col("cb").alias("b")), links, classes).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "hops")
    most = met.join(hops, ["ca", "cb"]).groupBy("tg_id").agg(F.max(F.when(F.col("ca") == F.col("cb"), 2).otherwise(F.col("hops")) + F.col("last")).alias("m"))
    kind = allocs.groupBy("tg_id").agg(F.bool_or(~F.col("is_switch")).cast("int").alias("first"))
    out = kind.join(edges.select(F.col("src_tg").alias("tg_id"), F.lit(True).alias("any")).distinct(), "tg_id", "left").join(most, "tg_id", "left")
    return out.select("tg_id", F.when(F.col("any"), F.coalesce("m", F.lit(0)) + F.col("first")).otherwise(-1).alias("max_diameter"))


def rack_reach(links: DataFrame) -> DataFrame:
    """(switch, rack): racks below each switch, a rack switch's own rack included, level by level; switches above racks by class, as those of a class reach the same."""
    classes, racks = switch_classes(links), rack_members(links).select("switch").distinct()
    up = switch_parents(links).join(classes.select(F.col("switch").alias("parent"), "class"), "parent").select("switch", F.col("class").alias("parent")).distinct()
    level = out = materialize(racks.select("switch", F.col("switch").alias("rack")), "racks")
    above = up.join(classes.select("switch", "class"), "switch").join(racks, "switch", "left_anti").select(F.col("class").alias("switch"), "parent").distinct()
    step = materialize(up.join(racks, "switch", "left_semi").unionByName(above).distinct(), "up")
    while not level.isEmpty():
        level = materialize(level.join(step, "switch").select(F.col("parent").alias("switch"), "rack").distinct(), "racks")
        out = out.unionByName(level)
    return out.distinct()


def detour_levels(groups: DataFrame, machines: DataFrame, links: DataFrame) -> DataFrame:
    """(tg_id, detour): levels by which a group's top switches must be lifted so that its switches reach all its servers; 2 more where the top of the topology isn't enough; -1 where a side is empty.

    groups: distinct (tg_id, machine_id, is_switch). Only the switches of the current top level are lifted; what is reached adds up. Servers count as their
    racks, and switches above racks as their classes, so that a group meets neither servers nor each core switch.
    """
    levels = machines.where("is_switch").select(F.col("machine_id").alias("switch"), "level")
    highest = levels.agg(F.max("level")).first()[0]
    racks = rack_members(links).select("switch").distinct().withColumn("is_rack", F.lit(True))
    name = switch_classes(links).join(racks, "switch", "left").join(levels, "switch").select("switch", F.when(F.col("is_rack"), F.col("switch")).otherwise(F.col("class")).alias("class"), "level")
    name = materialize(name, "names")
    up = switch_parents(links).join(name, "switch").select(F.col("class").alias("switch"), "parent", F.col("level").alias("l"))
    up = materialize(up.join(name.select(F.col("switch").alias("parent"), F.col("class").alias("to"), "level"), "parent").select("switch", "to", "level").distinct(), "ups")
    wanted = groups.where(~F.col("is_switch")).join(server_tor(links), F.col("machine_id") == F.col("server")).select("tg_id", F.col("tor").alias("rack")).distinct()
    wanted = materialize(wanted, "wanted")
    needs = wanted.groupBy("tg_id").agg(F.count("*").alias("wanted"))
    start = groups.where("is_switch").select("tg_id", F.col("machine_id").alias("switch")).join(name, "switch").select("tg_id", F.col("class").alias("switch"), "level").distinct()
    both = start.groupBy("tg_id").agg(F.max("level").alias("top")).join(needs, "tg_id")
    known = materialize(start.join(both.select("tg_id"), "tg_id", "left_semi").withColumn("lift", F.lit(0)), "lift")
    front = known.join(both, "tg_id").where("level = top").select("tg_id", "switch")
    for lift in range(1, (highest or 0) + 1):
        lifted = materialize(front.join(up, "switch").select("tg_id", F.col("to").alias("switch"), "level").distinct(), "lift")
        known = known.unionByName(lifted.withColumn("lift", F.lit(lift)))
        front = lifted.select("tg_id", "switch")
    covered = wanted.join(known.groupBy("tg_id", "switch").agg(F.min("lift").alias("lift")), "tg_id").join(rack_reach(links), ["switch", "rack"]).groupBy("tg_id", "rack").agg(F.min("lift").alias("lift"))
    need = covered.groupBy("tg_id").agg(F.count("*").alias("met"), F.max("lift").alias("need"))
    found = both.join(need, "tg_id", "left").select("tg_id", F.when(F.col("met") == F.col("wanted"), F.col("need")).otherwise(F.lit(highest) - F.col("top") + 2).alias("d"))
    return groups.select("tg_id").distinct().join(found, "tg_id", "left").select("tg_id", F.coalesce("d", F.lit(-1)).cast("int").alias("detour"))


def check_topology(machines: DataFrame, links: DataFrame, dims: dict[bool, int] | None = None) -> DataFrame:
    """Violations (machine_id, is_switch, rule). machines may have capacity arrays; dims: their sizes, for switches (True) and servers."""
    out = None
    for side in ("src", "dst"):
        ends = links.select(F.col(side).alias("machine_id"), F.col(f"{side}_is_switch").alias("is_switch")).distinct()
        loose = ends.join(machines.select("machine_id", "is_switch"), ["machine_id", "is_switch"], "left_anti").withColumn("rule", F.lit("link to nowhere"))
        out = loose if out is None else out.unionByName(loose)
    racks = links.where(~F.col("src_is_switch")).groupBy(F.col("src").alias("machine_id")).agg(F.count_distinct("dst").alias("n"))
    servers = machines.where(~F.col("is_switch")).join(racks, "machine_id", "left").where("n is null or n <> 1")
    out = out.unionByName(servers.select("machine_id", "is_switch", F.lit("not in one rack").alias("rule")))
    if dims and "capacity" in machines.columns:
        size = F.when(F.col("is_switch"), dims[True]).otherwise(dims[False])
        bad = machines.where(F.col("capacity").isNull() | (F.size("capacity") != size) | F.exists("capacity", lambda x: x < 0))
        out = out.unionByName(bad.select("machine_id", "is_switch", F.lit("capacity").alias("rule")))
    return out.distinct()
