"""Readers and writers on generated files with bad rows, zips, unfinished runs."""

import json
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelab.functions.expressions import parse_task_name
from tracelab.operators import clean, sweeps
from tracelab.sources import runs, trace

MACHINES = """m1,0,f1,g1,96,100,USING
m1,5,f1,g1,96,100,USING
 m1 ,9,f1,g1,96,100,USING
m1,12,f1,g1,96,100,IMPORT_INSTALLING
m1,14,f1,g1,96,100,IMPORT_INSTALLING
m2,3,f1,g1,64,50,USING
m2,3,f1,g1,64,50,IMPORT_INSTALLING
m3,1,f1,g1,64,50,BROKEN
m4,1,f1,g1,-1,50,USING
m5,x,f1,g1,64,50,USING
m6,1,f1
"""
TASKS = """M1,,j1,A,T,10,20,100,0.5
M1,5,j1,A,T,0,30,,0.7
R2_1,1,j1,A,T,15,0,50,0.1
R3_1_2,1,j1,A,T,40,40,50,0.1
MergeTask,2,j1,A,T,40,50,50,0.1
1abc,2,j1,A,T,40,50,50,0.1
M1,1,j2,A,T,40,30,50,0.1
M1,1,j3,A,T,10,20,50,101
task_abc==,1,j4,A,T,10,20,50,3
M1,1,j5,A,T,-5,20,50,3
"""


@pytest.fixture
def at(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    return put


def test_machines(spark, at):
    good, rejects = trace.read_machine_meta(spark, at("machine_meta.csv", MACHINES))
    assert Counter(r.reason for r in rejects.collect()) == {"time_stamp": 1, "columns": 1}
    machines, bad = clean.clean_machines(good)
    rows = sorted((r.machine, r.time, r.available) for r in machines.collect())
    assert rows == [("m1", 0, True), ("m1", 12, False), ("m1", 14, False), ("m2", 3, False), ("m2", 3, True)]
    assert Counter((r.machine_id, r.reason) for r in bad.collect()) == {("m3", "no event"): 1, ("m3", "status"): 1, ("m4", "cpu"): 1}
    with pytest.raises(ValueError, match="2 rows"):
        trace.read_machine_meta(spark, at("machine_meta.csv", MACHINES), strict=True)


def test_tasks_to_jobs(spark, at, tmp_path):
    good, rejects = trace.read_batch_task(spark, at("batch_task.csv", TASKS))
    assert [r.reason for r in rejects.collect()] == ["time"]
    assert [(r.task_name, r.reason) for r in clean.task_rejects(good).collect()] == [("1abc", "task name")]
    merged = {(r.job, r.name): r for r in clean.merge_task_rows(good).collect()}
    m1 = merged["j1", "M1"]
    assert (m1.instances, m1.cpu, m1.mem, m1.start_time, m1.end_time) == (5, 100.0, 0.7, 10, 30)
    assert list(merged["j1", "R3"].deps) == [2]
    tgs = clean.merge_task_rows(good)
    judged = clean.validate_tgs(clean.normalize_tg_times(tgs, clean.trace_horizon((good, ["start_time", "end_time"]))))
    by = {(r.job, r.name): r for r in judged.collect()}
    assert by["j1", "R2"].tg_end == 50 and by["j1", "R3"].duration == 1 and by["j2", "M1"].reason == "duration" and by["j3", "M1"].reason == "mem"
    kept, bad = clean.drop_jobs_with_bad_tg(judged)
    assert {r.job for r in kept.collect()} == {"j1", "j4"} and {r.job for r in bad.collect()} == {"j2", "j3"}
    edges = {(r.job, r.src, r.dst) for r in clean.build_dag(kept).collect()}
    assert edges == {("j1", "R2", "R3")}
    all_deps = clean.drop_jobs_with_bad_tg(clean.validate_tgs(clean.normalize_tg_times(clean.merge_task_rows(good, deps="all"), clean.trace_horizon((good, ["start_time", "end_time"])))))[0]
    assert {(r.src, r.dst) for r in clean.build_dag(all_deps, match="number").collect()} == {("M1", "R2"), ("M1", "R3"), ("R2", "R3")}
    path = str(tmp_path / "jobs")
    trace.write_clean_jobs(clean.clean_jobs(clean.connections(kept, clean.build_dag(kept))), path)
    back = {(r.job, r.task_group): list(r.connections) for r in trace.read_clean_jobs(spark, path).collect()}
    assert back["j1", "R2"] == ["R3"] and back["j1", "R3"] == []


def test_containers(spark, at):
    text = "c1,m1,5,app,started,4,8,1.5\nc1,m1,3,app,allocated,4,8,1.5\nc1,m1,9,app,unknow,4,8,1.5\nc2,m1,7,app,stopped,4,8,1.5\nc2,m1,8,app,stopped,4,8,1.5\nc3,m1,1,other,gone,4,8,1.5\n"
    good, rejects = trace.read_container_meta(spark, at("container_meta.csv", text))
    rows = {r.name: (r.job, r.start_time, r.end_time, r.instances) for r in clean.container_intervals(good).collect()}
    assert rejects.count() == 0 and rows == {"c1": ("containerapp", 3, None, 1), "c2": ("containerapp", None, 8, 1)}


@pytest.mark.parametrize(("name", "want"), [("J4_Stg1", ("J4", "J", [])), ("M2_1_Stg3", ("M2", "M", [1])), ("R3_1_2", ("R3", "R", [2])), ("MergeTask", ("MergeTask", None, [])), ("task_abc==", ("task_abc==", None, [])), ("1abc", None), ("M1\n", None)])
def test_task_names(spark, name, want):
    got = spark.createDataFrame([(name,)], "n string").select(parse_task_name(F.col("n")).alias("t")).first().t
    assert (None if got is None else (got.name, got.prefix, list(got.deps))) == want


def test_compress_status_like_a_loop(spark):
    rows = [(f"m{k % 7}", (k * 37) % 11, ["a", "b"][(k * k) % 3 % 2], k) for k in range(200)]
    got = {(r.m, r.o) for r in clean.compress_status(spark.createDataFrame(rows, "m string, t int, s string, o int"), ["m"], "t", "s", "o").collect()}
    want, by = set(), defaultdict(list)
    for m, t, s, o in rows:
        by[m].append((t, o, s))
    for m, some in by.items():
        some.sort()
        want |= {(m, o) for k, (_, o, s) in enumerate(some) if k in (0, len(some) - 1) or s != some[k - 1][2]}
    assert got == want


def test_run_directories(spark, at, tmp_path):
    def run(root, n, *, done=True, started=True, csv="Time,CountJobs,CountPreemptions\n1,2,3\n5,6\n", zipped=False):
        base = f"{root}/run-{n}"
        at(f"{base}/config.json", json.dumps({"--id": n, "--scheduler": ["hire", "k8-resubmit"][n % 2], "mu": 0.5, "--seed": n, "use-simple-flavor": "False"}))
        if started:
            at(f"{base}/START", "")
        if done:
            at(f"{base}/DONE", "")
        if zipped:
            with zipfile.ZipFile(tmp_path / base / "stats.zip", "w") as z:
                z.writestr("scheduler.csv", csv)
                z.writestr("cell.csv", "Time\n")
        elif csv is not None:
            at(f"{base}/scheduler.csv", csv)

    run("exp-a", 0)
    run("exp-a", 1, zipped=True)
    run("exp-a", 2, done=False)
    run("exp-a", 3, started=False, done=False)
    (tmp_path / "exp-a/run-4").mkdir()
    run("exp-a", 5, csv="")
    run("exp-b", 0)
    roots = [str(tmp_path / "exp-a"), str(tmp_path / "exp-b")]
    found = runs.discover_runs(spark, roots)
    assert {(r.experiment, r.run) for r in found.collect()} == {("exp-a", 0), ("exp-a", 1), ("exp-a", 5), ("exp-b", 0)}
    assert {(r.experiment, r.run) for r in runs.discover_runs(spark, roots, require_done=False).collect()} == {("exp-a", 0), ("exp-a", 1), ("exp-a", 2), ("exp-a", 5), ("exp-b", 0)}
    schema = "Time bigint, CountJobs bigint, CountPreemptions bigint"
    stats = runs.read_stats(spark, roots, "scheduler", found, schema)
    assert sorted((r.experiment, r.run, r.Time, r.CountPreemptions) for r in stats.where("Time = 1").collect()) == [("exp-a", 0, 1, 3), ("exp-b", 0, 1, 3)]
    assert stats.where("Time = 5 and CountPreemptions is null").count() == 2
    zipped = runs.read_stats_zip(spark, roots, "scheduler", schema)
    assert sorted((r.run, r.Time, r.CountJobs, r.CountPreemptions) for r in zipped.collect()) == [(1, 1, 2, 3), (1, 5, 6, None)]
    config = sweeps.with_family(sweeps.normalize_config(runs.read_run_configs(spark, roots)))
    names = {(r.experiment, r.run): r.value for r in config.where("key = 'scheduler-strategy'").collect()}
    assert names["exp-a", 0] == "hire" and names["exp-a", 1] == "resubmit"
    assert {r.key for r in sweeps.find_sweeps(config).collect()} == {"scheduler", "seed"}
    with pytest.raises(ValueError, match="columns exist"):
        sweeps.attach_config(stats, config, ["Time"])


def test_statistics_are_read_by_column_names(spark, at, tmp_path):
    """Each file has an order of its own; some lack a column or have one that isn't known."""
    names = [c.split()[0] for c in runs.stats_schema("cell-inp").split(", ")]
    assert names[1:5] == [f"{k}Switch_Prop2_Dim0" for k in ("Utilization", "Reserved", "Total", "BlockedByOthers")]
    orders = {0: names, 1: names[::-1], 2: ["Time", "UtilizationSwitch_Prop9_Dim2"], 3: ["Other", *names[5:], "Time"]}
    for n, order in orders.items():
        number = lambda c, t: t if c == "Time" else t + names.index(c) / 100 if c in names else 0
        lines = "".join(",".join(str(number(c, t)) for c in order) + "\n" for t in (1000, 2000))
        for f in ("config.json", "START", "DONE"):
            at(f"exp c/run-{n}/{f}", "{}")
        at(f"exp c/run-{n}/cell-inp.csv", ",".join(order) + "\n" + lines)
        with zipfile.ZipFile(tmp_path / f"exp c/run-{n}/stats.zip", "w") as z:
            z.writestr("cell-inp.csv", ",".join(order) + "\n" + lines)
    want = {(n, t): tuple(None if c not in order else float(t + names.index(c) / 100) for c in names[1:]) for n, order in orders.items() for t in (1000, 2000)}
    with pytest.warns(UserWarning, match="Other"):
        got = runs.read_stats(spark, [str(tmp_path / "exp c")], "cell-inp")
    for some in (got, runs.read_stats_zip(spark, [str(tmp_path / "exp c")], "cell-inp")):
        assert {(r.run, r.Time): tuple(r[c] for c in names[1:]) for r in some.collect()} == want
    at("exp d/run-0/cell-inp.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="no known column"):
        runs.read_stats(spark, [str(tmp_path / "exp d")], "cell-inp")
