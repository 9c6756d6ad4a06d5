"""Totals that grow by report and by interval."""

import numpy as np
import pandas as pd
import pytest

from tracelab.operators import tenant
from tracelab.streaming import live


def test_total_increase(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 1, 4), ("a", 3, 9)], "name string, at int, total long")
    got = {(r.name, r["at"]): r.increase for r in tenant.total_increase(rows, "name", "total", "at").collect()}
    assert got == {("a", 1): 5, ("a", 2): 4, ("a", 3): 0, ("b", 1): 4}


def test_running_totals(spark):
    rows = spark.createDataFrame([("x", 2, 3, 1.5), ("x", 1, 2, 0.5), ("y", 1, 7, 7.0)], "event string, start int, n long, value double")
    got = {(r.event, r.start): (r.n, r.value) for r in live.running_totals(rows, ["event"]).collect()}
    assert got == {("x", 1): (2, 0.5), ("x", 2): (5, 2.0), ("y", 1): (7, 7.0)}


class _State:
    def __init__(self):
        self.kept, self.asked = {}, 0

    def exists(self):
        return None in self.kept

    def get(self):
        return self.kept[None]

    def update(self, value):
        self.kept[None] = value

    def containsKey(self, key):
        return key in self.kept

    def getValue(self, key):
        self.asked += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.asked += 1
        self.kept[key] = value


@pytest.mark.parametrize("mode", ["once", "foreach", "never"])
def test_usage_asks_state_once_a_property(mode):
    """Two batches give what a loop over rows gives; state is asked and told once a property and batch, not once a row."""
    draw = np.random.default_rng(2)
    rows = pd.DataFrame({"seq": range(600), "time": draw.integers(0, 100, 600), "event": "claim", "machine_id": 1, "num_tasks": draw.integers(1, 4, 600), "own": draw.integers(1, 5, 600), "property": draw.choice(["a", "b", None], 600)})
    ends = rows.assign(seq=rows["seq"] + 1000, time=rows["time"] + draw.integers(0, 60, 600), event=draw.choice(["release", "preempt"], 600))
    log = pd.concat([rows, ends]).assign(demand=lambda x: x["property"].map({"a": 3, "b": 5}).fillna(2).astype(int)).sort_values(["time", "seq"])
    usage = live.Usage(mode)
    usage.used, usage.running = _State(), _State()
    halves = [log[log["time"] <= 50].sample(frac=1, random_state=1), log[log["time"] > 50].sample(frac=1, random_state=1)]
    found = pd.concat([x for half in halves for x in usage.handleInputRows((1,), iter([half.iloc[:100], half.iloc[100:]]), None)])
    reserved, used, running, want = 0, 0, {}, []
    for r in log.itertuples():
        step = 1 if r.event == "claim" else -1
        name = r.property if isinstance(r.property, str) else None
        before = running.get(name, 0)
        running[name] = before + step
        once = 0 if mode == "never" else step * r.demand if (before, step) in ((0, 1), (1, -1)) else 0
        reserved += step * r.num_tasks * r.own + (step * r.num_tasks * r.demand if mode == "foreach" else once)
        used += step * r.num_tasks * r.own + once
        want.append((r.seq, r.time, r.machine_id, reserved, used))
    assert list(found.itertuples(index=False, name=None)) == want
    assert usage.running.asked <= 12
