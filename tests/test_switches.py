"""Use of switches: the shared-resource cases, and random logs against a replay event by event."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelab.operators import switches

SCHEMA = "seq long, time long, event string, machine_id long, num_tasks long, properties array<string>, a long, b long"
#: Of 100 units, what is left on the switch after each claim and release of the shared-resource cases.
NEED = {"sharp": (10, 10), "harmonia": (15, 15), "bricks": (20, 20)}
LEFT = {
    (1, "foreach"): [65, 30, 65, 100], (1, "once"): [65, 45, 65, 100], (1, "deactivated"): [80, 60, 80, 100],
    (2, "foreach"): [65, 10, 65, 100], (2, "once"): [65, 25, 65, 100], (2, "deactivated"): [80, 50, 80, 100],
}


@pytest.mark.parametrize(("groups", "mode"), LEFT)
def test_shared_resource_cases(spark, groups, mode):
    second = (["harmonia"], 20) if groups == 1 else (["sharp", "harmonia"], 30)
    events = [(0, 10, "claim", ["harmonia"], 20), (1, 10, "claim", *second), (2, 20, "release", *second), (3, 30, "release", ["harmonia"], 20)]
    rows = spark.createDataFrame([(k, t, e, 2, 1, p, own, own) for k, t, e, p, own in events], SCHEMA)
    use = switches.switch_usage(switches.switch_demands(rows, ["a", "b"], NEED, mode), 2).orderBy("seq").collect()
    assert [[100 - x for x in r.reserved] for r in use] == [[x, x] for x in LEFT[groups, mode]]
    real = [x for x in LEFT[groups, "once" if mode == "foreach" else mode]]
    assert [100 - r.used[0] for r in use] == real


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        switches.switch_demands(spark.createDataFrame([], SCHEMA), ["a"], {}, "twice")


def log(names, allocations=60, machines=3, seed=0):
    draw, rows = random.Random(seed), []
    for k in range(allocations):
        start = draw.randrange(100)
        row = (draw.randrange(machines), draw.choice([1, 1, 2]), draw.sample(names, draw.choice([0, 1, 1, 2])), draw.randrange(5), draw.randrange(5))
        rows += [(2 * k, start, "claim", *row), (2 * k + 1, start + draw.randrange(1, 60), draw.choice(["release", "preempt"]), *row)]
    return rows


def replay(events, need, mode, capacity, interval):
    """(property, dim, tick) -> used, reserved, total, blocked: counters moved by one event after the other."""
    deltas, live = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(Counter)
    reserved = defaultdict(lambda: [0, 0])
    for _, time, event, m, tasks, props, *own in sorted(events, key=lambda e: (e[1], e[0])):
        step, before = (1 if event == "claim" else -1), {p for p, n in live[m].items() if n > 0}
        live[m].update({p: step for p in props})
        after = {p for p, n in live[m].items() if n > 0}
        turned, tick = before ^ after, -(-time // interval) * interval
        for d in range(2):
            once = sum(need[p][d] for p in turned) if mode != "never" else 0
            reserve = step * (tasks * (own[d] + sum(need[p][d] for p in props)) if mode == "foreach" else tasks * own[d] + once)
            real = step * (tasks * own[d] + once)
            others = reserved[m][d] if step > 0 else reserved[m][d] + reserve
            moves = [(p, (real, reserve, 0, 0)) for p in props] + [(p, (0, 0, step * capacity[d], step * others)) for p in turned] + [(p, (0, 0, 0, reserve)) for p in before - set(props)]
            for p, move in moves:
                deltas[p, d, tick] = [x + y for x, y in zip(deltas[p, d, tick], move, strict=True)]
            reserved[m][d] += reserve
    ticks, out = sorted({t for _, _, t in deltas}), {}
    for p, d in {k[:2] for k in deltas}:
        now = [0, 0, 0, 0]
        for t in range(ticks[0], ticks[-1] + 1, interval):
            now = [x + y for x, y in zip(now, deltas.get((p, d, t), [0] * 4), strict=True)]
            out[p, d, t] = now
    return out


@pytest.mark.parametrize(("mode", "n"), [("foreach", 4), ("once", 4), ("never", 4), ("foreach", 130)])
def test_inc_load_by_replay(spark, mode, n):
    """130 properties take more than one number of bits."""
    names = [f"p{k}" for k in range(n)]
    need = {p: (k % 7 + 1, k % 3) for k, p in enumerate(names)}
    events = log(names, allocations=60 if n < 10 else 150, seed=n)
    demands = switches.switch_demands(spark.createDataFrame(events, SCHEMA), ["a", "b"], need, mode)
    capacity = spark.range(3).select(F.col("id").alias("machine_id"), F.array(F.lit(500), F.lit(400)).alias("capacity"))
    load = switches.inc_load(demands, capacity, 2, 10, names)
    want = replay(events, need, mode, (500, 400), 10)
    assert {(r.property, r.dim, r.tick): [r.used, r.reserved, r.total, r.blocked] for r in load.collect()} == want
    for r in load.collect():
        used, reserved, total, blocked = want[r.property, r.dim, r.tick]
        assert [r.utilization, r.reserved_share, r.blocked_by_others] == ([0, 0, 0] if not total else [pytest.approx(x / total) for x in (used, reserved, blocked)])
        assert r.total_share == pytest.approx(total / (3 * (500, 400)[r.dim]))
    table = switches.load_table(load, [*names[:3], "never"], 2)
    assert table.columns[1:5] == [f"{k}Switch_Propp0_Dim0" for k in ("Utilization", "Reserved", "Total", "BlockedByOthers")] and len(table.columns) == 1 + 4 * 2 * 4
    for r in table.collect():
        assert r["UtilizationSwitch_Propnever_Dim1"] == 0 and r["ReservedSwitch_Propp1_Dim1"] == pytest.approx(want["p1", 1, r.Time][1] / want["p1", 1, r.Time][2] if want["p1", 1, r.Time][2] else 0)


def test_cell_table_by_replay(spark):
    names = ["x", "y", "z"]
    need, events = {p: (k + 1, 2) for k, p in enumerate(names)}, log(["x", "y", "z"], seed=9)
    rows = spark.createDataFrame(events, SCHEMA)
    capacity = rows.select("machine_id").distinct().withColumn("capacity", F.array(F.lit(500), F.lit(0)))
    table = switches.cell_table(rows, ["a"], capacity.withColumn("capacity", F.array(F.lit(50))), switches.switch_demands(rows, ["a", "b"], need, "foreach"), capacity, 2, 10, 3)
    assert table.columns == ["Time", "UtilizationSwitchINP", "UtilizationSwitchesDim0", "UtilizationSwitchesDim1", "ActualUtilizationSwitchesDim0", "ActualUtilizationSwitchesDim1", "UtilizationServersDim0"]
    for r in table.collect():
        seen = sorted((e for e in events if e[1] <= r.Time), key=lambda e: (e[1], e[0]))
        live = defaultdict(Counter)
        reserved = used = server = 0
        for _, _, event, m, tasks, props, a, _ in seen:
            step, before = (1 if event == "claim" else -1), {p for p, n in live[m].items() if n > 0}
            live[m].update({p: step for p in props})
            turned = before ^ {p for p, n in live[m].items() if n > 0}
            server += step * tasks * a
            reserved += step * tasks * (a + sum(need[p][0] for p in props))
            used += step * (tasks * a + sum(need[p][0] for p in turned))
        active = sum(1 for c in live.values() for n in c.values() if n > 0)
        assert r.UtilizationSwitchINP == pytest.approx(active / 9) and r.UtilizationSwitchesDim0 == pytest.approx(reserved / 1500)
        assert r.ActualUtilizationSwitchesDim0 == pytest.approx(used / 1500) and r.UtilizationServersDim0 == pytest.approx(server / 150) and r.UtilizationSwitchesDim1 is None


def test_one_shuffle_by_switch(spark):
    """The sweep deals events by switch once; sums by tick and the capacities are the rest."""
    rows = spark.createDataFrame(log(["x", "y"]), SCHEMA)
    plan = switches.switch_usage(switches.switch_demands(rows, ["a", "b"], {"x": (1, 1)}, "foreach"), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
