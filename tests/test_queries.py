"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from tracelab.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert len(set(cols)) == len(df.columns)
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_plans_are_distributed(spark):
    """No cartesian products of tables and no window over a whole table."""
    for name in ("c2_server_usage", "c5_cell_utilization", "t8_scheduler_counters", "h3_log_cdf", "e11_five_number", "a12_drop_jobs_with_bad_tg", "c12_capacity_fit"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name
        for line in plan.splitlines():
            assert not ("Window" in line and "SinglePartition" in line), name


def test_composites_are_of_all_jobs(spark):
    """Submissions outside b2_trace_window's window have parts and edges too."""
    inside = {r.job for r in QUERIES["b2_trace_window"](spark, SF).select("job").distinct().collect()}
    for name in ("b10_expand_composites", "b12_rewire_composites"):
        assert {r.job for r in QUERIES[name](spark, SF).select("job").distinct().collect()} - inside, name


@pytest.mark.parametrize("name", ("c12_capacity_of_groups", "c12_capacity_of_all_tasks"))
def test_overfull_machines_take_no_tasks(duck, name):
    """With six times the events most switches are overfull: no group may fit a negative number of tasks, in SQL either."""
    con = duck.cursor()
    sql = SQL[name].replace("from events", "from more_events")
    con.execute(f"create temp view more_events as select * replace (event_id + k * 1000000 as event_id, user_id + k * 100000 as user_id) from '{SF}/../sf0.01/events.parquet' cross join range(60) as r(k)")
    least, none = con.execute(f"select min(tasks), count(*) filter (where tasks = 0) from ({sql})").fetchone()
    assert least == 0 and none > 0


@pytest.mark.parametrize("name", ("b12_rewire_composites", "b14_check_jobs"))
def test_units_are_made_once(spark, name):
    """What is met several times is read as staged; nothing goes back to the trace."""
    assert "lineitem" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()
