"""Jobs over time against replays: pending jobs with flavors, preemptions with withdraws, snapshots, and how many tasks fit."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelab.operators import capacity, snapshots, tenant
from tracelab.sources.topology import fat_tree


def might(group, chosen, excluded):
    return not group["out"] or not (group["out"] & chosen or group["in"] & excluded)


def surely(group, chosen, excluded):
    return not group["out"] or bool(chosen and group["in"] & chosen and not group["out"] & chosen and not group["in"] & excluded and group["out"] <= excluded)


def world(seed, jobs=12):
    """Groups with options of several bits, claims and preemptions, options chosen and given up, withdraws."""
    draw = random.Random(seed)
    groups, allocs, told, gone = [], [], [], {}
    for j in range(jobs):
        for t in range(draw.randrange(1, 4)):
            own = set(draw.sample([1, 2, 3, 4], draw.randrange(0, 3)))
            g = {"job": j, "tg": 10 * j + t, "at": draw.randrange(0, 300), "n": draw.randrange(1, 4), "in": own, "out": set(draw.sample([b for b in (1, 2, 3, 4) if b not in own], draw.randrange(0, 2))) if own else set()}
            groups.append(g)
            left = g["n"]
            time = g["at"]
            while left and draw.random() < 0.85:
                n = draw.randrange(1, left + 1)
                time += draw.randrange(0, 80)
                lost = time + draw.randrange(1, 200) if draw.random() < 0.3 else None
                allocs.append({"tg": g["tg"], "job": j, "start": time, "n": n, "lost": lost, "machine": draw.randrange(16)})
                left -= n
        for _ in range(draw.randrange(0, 4)):
            told.append((j, draw.randrange(0, 500), draw.random() < 0.7, set(draw.sample([1, 2, 3, 4], 1)), set(draw.sample([1, 2, 3, 4], 1))))
        if draw.random() < 0.2:
            gone[j] = draw.randrange(100, 600)
    return groups, allocs, told, gone


def options_at(told, job, now):
    chosen, excluded = set(), set()
    for seq, (j, time, on, inc, exc) in sorted(enumerate(told), key=lambda x: (x[1][1], x[0])):
        if j == job and time <= now:
            chosen, excluded = (chosen | inc, excluded | exc) if on else (chosen - inc, excluded - exc)
    return chosen, excluded


def frames(spark, groups, allocs, told):
    tgs = spark.createDataFrame([(g["job"], g["tg"], g["at"], g["n"], sorted(g["in"]), sorted(g["out"]), g["tg"] % 2 == 1, 5, 6) for g in groups], "job_id long, tg_id long, submitted long, num_tasks long, in_option array<int>, not_in_option array<int>, is_switch boolean, duration long, original_duration long")
    options = spark.createDataFrame([(j, k, t, "flavor_chosen" if on else "flavor_removed", sorted(i), sorted(e)) for k, (j, t, on, i, e) in enumerate(told)], "job_id long, seq long, time long, event string, included array<int>, excluded array<int>")
    return tgs, options


@pytest.mark.parametrize("seed", range(4))
def test_pending_jobs_by_replay(spark, seed):
    groups, allocs, told, gone = world(seed)
    tgs, options = frames(spark, groups, allocs, told)
    events = [(a["tg"], a["start"], "claim", a["n"]) for a in allocs] + [(a["tg"], a["lost"], "preempt", a["n"]) for a in allocs if a["lost"]]
    spans = tenant.placed_spans(spark.createDataFrame(events, "tg_id long, time long, event string, num_tasks long"), tgs)
    leaves = spark.createDataFrame(list(gone.items()), "job_id long, time long")
    got = {(r.placed, r.tick): r.n for r in tenant.pending_jobs(tgs, spans, 10, options=options, withdrawn=leaves, last=900).where("n > 0").collect()}

    def lacking(job, now, submitted):
        chosen, excluded = options_at(told, job, now)
        running = lambda tg: sum(a["n"] for a in allocs if a["tg"] == tg and a["start"] <= now and not (a["lost"] and a["lost"] <= now))
        return any(g["job"] == job and running(g["tg"]) < g["n"] and might(g, chosen, excluded) and (not submitted or g["at"] <= now) for g in groups)

    want = defaultdict(int)
    for job in {g["job"] for g in groups}:
        since = min(g["at"] for g in groups if g["job"] == job)
        ends = [t for t in range(since, 1000) if not lacking(job, t, False)]
        end = min([*ends[:1], *([gone[job]] if job in gone else [])], default=None)
        for tick in range(0, 901, 10):
            if tick >= since and (end is None or tick < end):
                want[not lacking(job, tick, True), tick] += 1
    assert got == dict(want)


@pytest.mark.parametrize("seed", range(3))
def test_preemptions_with_withdraws(spark, seed):
    draw = random.Random(seed)
    rows, gone = [], {j: draw.randrange(50, 400) for j in range(0, 20, 3)}
    for k in range(200):
        start = draw.randrange(300)
        rows.append((draw.randrange(18), start, start + draw.randrange(1, 200), draw.choice(["release", "preempt", None]), draw.randrange(1, 5)))
    events = [(j, s, "claim", n) for j, s, _, _, n in rows] + [(j, e, how, n) for j, _, e, how, n in rows if how]
    got = {r.job_id: r[1:] for r in tenant.preemption_counts(spark.createDataFrame(events, "job_id long, time long, event string, num_tasks long"), spark.createDataFrame([(j, t, "withdraw") for j, t in gone.items()], "job_id long, time long, event string")).collect()}
    want = {}
    for j in {r[0] for r in rows} | set(gone):
        end = gone.get(j, 10**9)
        own = [r for r in rows if r[0] == j and r[1] <= end]
        times = {e for _, _, e, how, _ in own if how == "preempt" and e <= end}
        alive = sum(n for _, _, e, how, n in own if not (how and e <= end)) if j in gone else 0
        tasks = sum(n for _, _, e, how, n in own if how == "preempt" and e <= end) + (sum(r[4] for r in own) if j in gone else 0)
        if times or j in gone:
            want[j] = (len(times | ({end} if alive else set())), end if j in gone else max(times), tasks, alive)
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_snapshots_by_replay(spark, seed):
    groups, allocs, told, gone = world(10 + seed)
    done = {j: 450 for j in range(0, 12, 4) if j not in gone}
    tgs, options = frames(spark, groups, allocs, told)
    none = F.array().cast("array<int>")
    ends = spark.createDataFrame([(j, 0, t, "withdraw") for j, t in gone.items()] + [(j, 0, t, "done") for j, t in done.items()], "job_id long, seq long, time long, event string").withColumns({"included": none, "excluded": none})
    table = spark.createDataFrame([(a["tg"], a["machine"], a["start"], a["n"], a["lost"]) for a in allocs], "tg_id long, machine_id long, start_time long, num_tasks long, preempted_at long")
    edges = spark.createDataFrame([(g["tg"], h["tg"]) for g in groups for h in groups if g["job"] == h["job"] and g["tg"] < h["tg"]], "src_tg long, dst_tg long")
    times = [700, 100, 250, 450]
    got, jobs = snapshots.tenant_tables(tgs, table, options.unionByName(ends), times, None, edges, *fat_tree(spark, 4))
    got = {(r.snapshot, r.TaskGroupID): r for r in got.collect()}
    want, status = {}, {}
    for t in times:
        for g in groups:
            end = gone.get(g["job"], done.get(g["job"]))
            now = t if end is None or end > t else end
            if g["at"] > now:
                continue
            withdrawn = end is not None and end <= t and g["job"] in gone
            chosen, excluded = options_at(told, g["job"], now)
            live = lambda tg, now=now: [a for a in allocs if a["tg"] == tg and a["start"] <= now and not (a["lost"] and a["lost"] <= now)]
            short = any(h["job"] == g["job"] and might(h, chosen, excluded) and sum(a["n"] for a in live(h["tg"])) < h["n"] for h in groups)
            state = "W" if withdrawn else "D" if end is not None and end <= t else "O" if short else "A"
            status[t, g["job"]] = state
            if not might(g, chosen, excluded):
                continue
            own = [] if withdrawn else live(g["tg"])
            started = sum(a["n"] for a in own)
            waits = sum((a["start"] - g["at"]) * a["n"] for a in own) + (now - g["at"]) * (g["n"] - started)
            racks = {a["machine"] if g["tg"] % 2 else a["machine"] // 2 for a in own}
            heirs = any(h["job"] == g["job"] and h["tg"] > g["tg"] and h["at"] <= now and surely(h, chosen, excluded) for h in groups)
            want[t, g["tg"]] = (state, started, waits / g["n"], max([a["start"] for a in own], default=-1), len(racks), heirs)
    assert set(got) == set(want)
    for k, (state, started, waits, last, racks, heirs) in want.items():
        r = got[k]
        assert (r.JobStatus, r.TasksStarted, r.PlacementLatency, r.InvolvedRacks, r.MaxDiameter >= 0) == (state, started, last, racks, heirs) and r.AvgQueueing == pytest.approx(waits), k
    assert {(r.snapshot, r.JobID): r.JobStatus for r in jobs.collect()} == status


@pytest.mark.parametrize("ignore", [False, True])
def test_capacity_by_brute_force(spark, ignore):
    draw = random.Random(3)
    need = {"x": (5, 1), "y": (2, 2)}
    machines = [(m, m >= 30, [draw.randrange(60), draw.randrange(60)], draw.choice([["x", "y", "z"], ["x"], []]) if m >= 30 else [], draw.choice([[], ["x"], ["y", "z"]]) if m >= 30 else []) for m in range(60)]
    groups = [(g, [draw.randrange(12), draw.randrange(12)], g % 2 == 1, draw.choice([[], ["x"], ["x", "y"]]) if g % 2 else [], draw.random() < 0.5, draw.randrange(6)) for g in range(40)]
    held = [(draw.randrange(40), draw.randrange(60)) for _ in range(400)]
    want = {}
    for g, demand, switch, props, together, waiting in groups:
        limit = (capacity.UNLIMITED if ignore else waiting) if together else min(1, 1 if ignore else waiting)
        fits = []
        for m, kind, free, supported, active in machines:
            if kind != switch:
                continue
            total = [d + (sum(need.get(p, (0, 0))[k] for p in props if p not in active) if switch else 0) for k, d in enumerate(demand)]
            k = min([f // d for f, d in zip(free, total, strict=True) if d > 0], default=capacity.UNLIMITED)
            if switch and (not set(props) <= set(supported) or (set(props) - set(active) and len(set(props) | set(active)) > 2)):
                k = 0
            if not together and not ignore and (g, m) in held:
                k = 0
            fits.append(min(k, limit))
        want[g] = (sum(k > 0 for k in fits), sum(fits))
    tgs = spark.createDataFrame(groups, "tg_id long, demand array<long>, is_switch boolean, properties array<string>, co_locate boolean, not_started long")
    table = spark.createDataFrame(machines, "machine_id long, is_switch boolean, free array<long>, supported array<string>, active array<string>")
    got = capacity.capacity_fit(tgs, table, 2, spark.createDataFrame(held, "tg_id long, machine_id long"), need, "once", ignore)
    assert {r.tg_id: (r.machines, r.tasks) for r in got.collect()} == want


def test_options_and_moves_come_from_one_pass(spark):
    """Unions of the same events dealt by job met other joins with other numbers of partitions, once one side became a broadcast."""
    groups, allocs, told, _ = world(1)
    tgs, options = frames(spark, groups, allocs, told)
    points = snapshots._Points(tgs, options, [100, 400])
    assert "Union" not in snapshots._options_at(points, options)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in tenant.job_options_at(options, 400)._jdf.queryExecution().optimizedPlan().toString()


def test_flavors_meet_kinds_of_groups(spark):
    """A job's flavors times its groups grow with the square of the job; groups of the same options are one kind."""
    tgs = spark.range(60).selectExpr("0L as job_id", "id as tg_id", "id as submitted", "array(1) as in_option", "array(2) as not_in_option")
    told = spark.range(40).selectExpr("0L as job_id", "id as seq", "id as time", "if(id % 2 = 0, 'flavor_chosen', 'flavor_removed') as event", "array(2) as included", "array(1) as excluded")
    kinds = tgs.select("job_id", "in_option", "not_in_option").distinct()
    assert tenant._ruled_out(kinds, told, []).count() == 2 * 40
    placed = tgs.selectExpr("tg_id", "submitted + 1000 as full_time")
    got = {(r.placed, r.tick): r.n for r in tenant.pending_jobs(tgs, placed, 10, options=told).where("n > 0").collect()}
    assert got == {}  # ruled out at 0, when its first group comes: no group lacks tasks, so the job ends there
    got = {(r.placed, r.tick): r.n for r in tenant.pending_jobs(tgs, placed, 10, options=told.where("seq > 4 and seq < 6")).where("n > 0").collect()}
    assert got == {(False, t): 1 for t in range(0, 1060, 10)}


def test_groups_that_are_placed_once_take_one_sweep(spark, monkeypatch):
    draw, plans, real = random.Random(3), [], tenant.state_intervals
    monkeypatch.setattr(tenant, "state_intervals", lambda spans, *more: plans.append(spans._jdf.queryExecution().optimizedPlan().toString()) or real(spans, *more))
    rows = [(g % 40, g, draw.randrange(0, 400, 5), None if draw.random() < 0.2 else draw.randrange(0, 500, 5)) for g in range(130)]
    groups = spark.createDataFrame(rows, "job_id long, tg_id long, submitted long, full_time long")
    placed, gone = groups.where("full_time is not null").select("tg_id", "full_time"), spark.createDataFrame([], "job_id long, time long")
    tgs = groups.select("job_id", "tg_id", "submitted")
    once, general = ({(r.placed, r.tick): r.n for r in tenant.pending_jobs(tgs, placed, 10, withdrawn=w).where("n > 0").collect()} for w in (None, gone))
    assert once == general and len(once) > 50
    assert plans[0].count("Window [") == 1


def test_locality_is_written_part_by_part(spark, monkeypatch):
    names, real = [], snapshots.materialize
    monkeypatch.setattr(snapshots, "materialize", lambda df, name: names.append(name) or real(df, name))
    present = spark.createDataFrame([(1, 0, False), (2, 1, False)], "tg_id long, machine_id long, is_switch boolean")
    edges = spark.createDataFrame([(1, 2)], "src_tg long, dst_tg long")
    found = snapshots.locality(present, present.select("tg_id", "is_switch"), edges, *fat_tree(spark, 4)).collect()
    assert len(found) == 2 and {"sides", "detour", "diameter", "locality"} <= set(names)
