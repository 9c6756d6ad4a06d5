"""Operators against brute force and stated values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tracelab.functions import expressions as X
from tracelab.operators import figures, histogram, mappers, tenant, topology, usage, workload
from tracelab.sources import topology as source

# Reserved switch resources, of 100, after each claim and release of the shared-resource cases.
CASES = {
    ("same", "foreach"): [65, 30, 65, 100],
    ("same", "once"): [65, 45, 65, 100],
    ("same", "deactivated"): [80, 60, 80, 100],
}


@pytest.mark.parametrize("mode", ["foreach", "once", "deactivated"])
def test_shared_resources(spark, mode):
    events = [(k, k, e, 1, 1, "harmonia", 20) for k, e in enumerate(["claim", "claim", "release", "release"])]
    rows = spark.createDataFrame(events, "seq long, time long, event string, machine_id long, num_tasks long, property string, own long")
    shared = spark.createDataFrame([("harmonia", 15)], "property string, demand long")
    got = [100 - r.reserved for r in usage.shared_demand_usage(rows, "own", shared, mode).orderBy("seq").collect()]
    assert got == CASES["same", mode]


def graph(links):
    up = {}
    for r in links:
        if r.src_is_switch:
            up.setdefault(r.src, set()).add(r.dst)
    return up


@pytest.mark.parametrize("make", [lambda s: source.fat_tree(s, 4), lambda s: source.fat_tree(s, 6), lambda s: source.binary_tree(s, 3)])
def test_topology_by_brute_force(spark, make):
    machines, links = make(spark)
    assert topology.check_topology(machines, links).count() == 0
    rows = links.collect()
    up, tor = graph(rows), {r.src: r.dst for r in rows if not r.src_is_switch}
    level = {r.machine_id: r.level for r in machines.where("is_switch").collect()}
    assert {r.server: r.tor for r in topology.server_tor(links).collect()} == tor
    reach = {s: set() for s in level}
    for server, t in tor.items():
        todo = {t}
        while todo:
            for s in todo:
                reach[s].add(server)
            todo = set().union(*(up.get(s, set()) for s in todo))
    got = {}
    for r in topology.reachable_servers(links).collect():
        got.setdefault(r.switch, set()).add(r.server)
    assert got == {s: v for s, v in reach.items() if v}
    near = {s: set(up.get(s, ())) for s in level}
    for s, ps in up.items():
        for p in ps:
            near[p].add(s)
    hops = {}
    for a in level:
        seen, front, d = {a}, {a}, 0
        while front:
            hops |= {(a, b): d for b in front}
            front = set().union(*(near[b] for b in front)) - seen
            seen |= front
            d += 1
    assert {(r.a, r.b): r.hops for r in topology.switch_distance(links).collect()} == hops
    pairs = spark.createDataFrame(list(hops), "a long, b long")
    assert {(r.a, r.b): r.hops for r in topology.switch_hops(pairs, links).collect()} == hops
    draw, groups, want = random.Random(1), [], {}
    for g in range(60):
        ss, vs = draw.sample(sorted(level), draw.randrange(0, 3)), draw.sample(sorted(tor), draw.randrange(0, 4))
        if not ss and not vs:
            continue
        groups += [(g, s, True) for s in ss] + [(g, v, False) for v in vs]
        if not ss or not vs:
            want[g] = -1
            continue
        top, lifts = max(level[s] for s in ss), 0
        front, seen = {s for s in ss if level[s] == top}, set().union(*(reach[s] for s in ss))
        while not set(vs) <= seen and top + lifts < max(level.values()):
            front = set().union(*(up.get(s, set()) for s in front))
            lifts += 1
            seen |= set().union(*(reach[s] for s in front))
        want[g] = lifts if set(vs) <= seen else lifts + 2
    table = spark.createDataFrame(groups, "tg_id long, machine_id long, is_switch boolean")
    assert {r.tg_id: r.detour for r in topology.detour_levels(table, machines, links).collect()} == want


def test_fat_tree_sizes(spark):
    machines, links = source.fat_tree(spark, 8)
    assert machines.where("is_switch").count() == 80 and machines.where("not is_switch").count() == 128 and links.count() == 128 * 3


def test_bad_topology(spark):
    machines, links = source.binary_tree(spark, 1)
    extra = spark.createDataFrame([(0, False, 2, True), (0, True, 99, True)], links.schema)
    assert {(r.machine_id, r.rule) for r in topology.check_topology(machines, links.unionByName(extra)).collect()} == {(99, "link to nowhere"), (0, "not in one rack")}


@pytest.mark.parametrize("values", [[5], [3, 1], [4, 9, 1], list(range(10)), [2, 2, 7, 7]])
def test_upper_median(spark, values):
    got = histogram.upper_median_stats(spark.createDataFrame([(0, v) for v in values], "k int, v long"), "v", ["k"]).first()
    assert (got["min"], got["mean"], got["median"], got["max"]) == (min(values), sum(values) // len(values), sorted(values)[len(values) // 2], max(values))


def test_log_cdf_keeps_every_sample(spark):
    draw = random.Random(5)
    rows = [(0, k % 3, math.exp(draw.gauss(0, 2))) for k in range(1001)] + [(0, 0, 0.0), (1, 0, 5.0)]
    out = histogram.log_cdf(spark.createDataFrame(rows, "c int, run int, x double"), "x", ["run"], ["c"], 100)
    last = out.where("bin = 98").collect()
    assert {(r.c, r.run): round(r.cdf, 9) for r in last} == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (1, 0): 1}


def test_histograms_of_odd_groups(spark):
    rows = [("one", 4.0), ("one", 4.0), ("two", 0.0), ("two", 10.0), ("two", 9.99), ("none", None)]
    got = histogram.auto_histogram(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], 3).collect()
    assert sorted((r.g, r.bin, r.edge, r.n) for r in got) == [("two", 0, 0.0, 1), ("two", 1, 5.0, 1), ("two", 2, 10.0, 1)]
    unit = histogram.unit_histogram(spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 0.5)], "g string, x double"), "x", ["g"], 4)
    assert [r.n for r in unit.orderBy("bin").collect()] == [1, 0, 1, 1]


def test_max_waiting_time_by_hand(spark):
    draw = random.Random(2)
    spans = [(s := draw.randrange(0, 5000), s + draw.randrange(0, 3000)) for _ in range(60)]
    got = {r.tick: r.waiting for r in tenant.max_waiting_time(spark.createDataFrame(spans, "submitted long, until long"), 100).collect()}
    want = {}
    for t in range(-(-min(s for s, _ in spans) // 100) * 100, -(-max(u for _, u in spans) // 100) * 100 + 1, 100):
        waiting = [s for s, u in spans if s <= t and t < -(-u // 100) * 100 and t >= -(-s // 100) * 100]
        want[t] = t - min(waiting) if waiting else 0
    assert got == want


def test_composites(spark):
    rows = [("j", f"t{k}", "DAG", k, 10, n, t, 10, n, True, [1, 1]) for k, (t, n) in enumerate(itertools.product(["daiet", "netcache", "hovercraft", "netchain"], [1, 100, 20000]))]
    tgs = spark.createDataFrame(rows, "job string, task_group string, type string, submit long, duration long, instances long, inc_type string, reduced_duration long, reduced_tasks long, tg_flavored boolean, resources array<bigint>")
    parts = workload.flavor_bits(workload.expand_composites(tgs, 10_000))
    by = {}
    for r in parts.collect():
        by.setdefault((r.inc_type, r.instances), []).append(r)
    for (kind, n), some in by.items():
        root = [r for r in some if r.part == "switch"][0]
        ln = math.ceil(math.log(n)) if n > 1 else 0
        want = {"daiet": max(1, ln), "netcache": max(3, ln), "hovercraft": max(1, n // 9000), "netchain": max(3, 3 * n // 1000)}[kind]
        assert root.tasks == want
        below, level = 0, 1
        while kind == "daiet" and below < want - 1:
            below, level = below + 2**level, level + 1
        assert sum(r.part == "child" for r in some) == below
        assert {tuple(r.in_option) for r in some if r.part == "server"} == {tuple(r.not_in_option) for r in some if r.part != "server"}
    edges = workload.rewire_edges(spark.createDataFrame([("j", "t0", "t3")], "job string, src string, dst string"), parts)
    assert workload.check_jobs(parts, edges).count() == 0


def test_quotas(spark):
    jobs = spark.createDataFrame([(f"j{k:04}", k) for k in range(950)], "job string, submitted long")
    out = workload.select_flavored_jobs(jobs, 0.3, 100)
    assert out.count() == 950 and out.where("flavored and submitted < 100").count() == 0
    n = {r.b: r.n for r in out.where("ordinal is not null").groupBy(F.floor(F.col("ordinal") / 100).alias("b")).agg(F.count_if("flavored").alias("n")).collect()}
    assert set(n.values()) <= {30, 15}


def test_mean_band(spark):
    rows = spark.createDataFrame([(k % 2, k, float(k % 7)) for k in range(400)], "g int, k int, y double")
    for method in ("bootstrap", "normal"):
        for r in figures.mean_band(rows, ["g"], "y", ["k"], n_boot=200, method=method).collect():
            assert r.low < r.mean < r.high and r.high - r.low < 1.2


def test_divisions_by_zero_are_null(spark):
    row = {"CountJobs": 1, "TimesServerFallbackResubmit": 1, "CountJobsWithInp": -1, "TotalJobsFullyScheduledINP": 1, "TimesSwitchFlavorTaken": 1, "CountPreemptions": 0, "ScheduledTasks": 0, "TotalJobsFullyScheduled": 1, "PendingJobsFullyScheduled": 0}
    out = mappers.success_ratios(spark.createDataFrame([tuple(row.values())], list(row))).first()
    assert out.SchedulingSuccess is None and out.WastedAllocations is None and out.AllocatedIncSuccess is None


def test_expressions(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first().x
    assert ask(X.ms_to_human(F.lit(3_723_004))) == "1:02:03.004"
    assert ask(X.scheduler_family(F.lit("k8-resubmit"))) == "resubmit" and ask(X.scheduler_family(F.lit("x"))) == "unknown"
    assert ask(X.load_level(F.lit(30), F.lit(100), 10)) == 7 and ask(X.load_level(F.lit(0), F.lit(0), 10)) == 0
    assert 0 <= ask(X.hash_unit(1, F.lit("a"))) < 1
