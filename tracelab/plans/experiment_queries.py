"""Queries: experiments. Run directories are written from the test tables by Spark and read like any others."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators import figures, mappers, sweeps
from tracelab.plans import paper_frames
from tracelab.plans.experiments import load_experiments
from tracelab.plans.registry import query, rounded
from tracelab.plans.result_queries import INC_VIEW, inc_wide
from tracelab.plans.views import view
from tracelab.sources import runs as source
from tracelab.sources import topology, trace
from tracelab.sources.scratch import scratch_path

SCHEMA = "Time bigint, CountJobs bigint, CountPreemptions bigint"
SCHEDULERS = ("hire", "k8-resubmit", "yarn-greedy")


def run_directories(spark: SparkSession, sf: str) -> str:
    """A root with six runs of the counters; run 5 isn't done."""
    root = scratch_path(spark, "exp-a")
    put = lambda path, text: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rows = view(spark, sf, "counters").select("run", "Time", "CountJobs", "CountPreemptions").persist()
    for run in range(6):
        at = f"{root}/run-{run}"
        put(f"{at}/config.json", json.dumps({"--id": run, "--scheduler": SCHEDULERS[run % 3], "--mu": 0.25 if run % 2 == 0 else 0.5, "--seed": run, "--use-simple-flavor": "false" if run % 2 else False, "--cell": "fat-tree"}))
        put(f"{at}/START", "")
        if run != 5:
            put(f"{at}/DONE", "")
        rows.where(F.col("run") == run).drop("run").write.option("header", True).csv(f"{at}/scheduler.csv")
    rows.unpersist()
    return root


CONFIG = """config as (select run, key, value from (select distinct run from runs), (select unnest(['scheduler', 'mu', 'seed', 'use-simple-flavor', 'cell']) as key),
lateral (select case key when 'scheduler' then ['hire', 'k8-resubmit', 'yarn-greedy'][run % 3 + 1] when 'mu' then case when run % 2 = 0 then '0.25' else '0.5' end when 'seed' then cast(run as varchar) when 'cell' then 'fat-tree' else 'false' end as value) where run <> 5)"""


@query("select distinct run, true as done from runs where run <> 5", "runs")
def s5_discover_runs(spark: SparkSession, sf: str) -> DataFrame:
    return source.discover_runs(spark, [run_directories(spark, sf)]).select("run", "done")


@query(f"with {CONFIG} select run, key, value from config union all select distinct run, 'id', cast(run as varchar) from runs where run <> 5", "runs")
def s6_read_run_configs(spark: SparkSession, sf: str) -> DataFrame:
    config = source.read_run_configs(spark, [run_directories(spark, sf)])
    return config.where("run <> 5").select("run", F.ltrim(F.col("key"), F.lit("-")).alias("key"), "value")


@query("select run, Time, CountJobs, CountPreemptions from counters where run <> 5", "counters")
def s7_read_stats(spark: SparkSession, sf: str) -> DataFrame:
    root = run_directories(spark, sf)
    return source.read_stats(spark, [root], "scheduler", source.discover_runs(spark, [root]), SCHEMA).drop("run_dir", "experiment")


@query("select run, Time, CountJobs::double as utilization, case when run % 2 = 0 then CountPreemptions::double end as reserved from counters", "counters")
def s7_read_cell_inp(spark: SparkSession, sf: str) -> DataFrame:
    """In-network load of runs whose files have their columns in different orders; odd runs lack one."""
    root, rows = scratch_path(spark, "exp-inp"), view(spark, sf, "counters")
    load, reserved = F.col("CountJobs").alias("UtilizationSwitch_Prop2_Dim0"), F.col("CountPreemptions").alias("ReservedSwitch_Prop2_Dim0")
    for run in range(6):
        some = rows.where(F.col("run") == run)
        (some.select("Time", load, reserved) if run % 2 == 0 else some.select(load, "Time")).write.option("header", True).csv(f"{root}/run-{run}/cell-inp.csv")
    read = source.read_stats(spark, [root], "cell-inp")
    return read.select("run", "Time", F.col("UtilizationSwitch_Prop2_Dim0").alias("utilization"), F.col("ReservedSwitch_Prop2_Dim0").alias("reserved"))


@query("select run, Time, round(value, 4) as value from runs", "runs")
def s10_write_stats(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stats")
    source.write_stats(view(spark, sf, "runs").select("experiment", "run", "Time", "value"), path)
    return rounded(spark.read.parquet(path).select("run", "Time", "value"))


def _config(spark: SparkSession, sf: str) -> DataFrame:
    """The runs' configuration from the view, long."""
    rows = view(spark, sf, "runs").select("experiment", "run", "scheduler", "mu").distinct()
    given = {"--scheduler": F.col("scheduler"), "--mu": F.col("mu").cast("string"), "--seed": F.col("run").cast("string"), "--cell": F.lit("fat-tree"), "--id": F.col("run").cast("string"), "--verbose": F.lit("True")}
    pairs = F.explode(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v)])).alias("key", "value")
    return rows.select("experiment", "run", pairs)


LONG = """long as (select distinct run, scheduler, mu from runs), config as (select run, unnest(['scheduler', 'mu', 'seed', 'cell', 'verbose']) as key, unnest([scheduler, cast(mu as varchar), cast(run as varchar), 'fat-tree', 'true']) as value from long)"""


@query(f"with {LONG} select run, key, value from config", "runs")
def d1_normalize_config(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.normalize_config(_config(spark, sf)).select("run", "key", "value")


@query("select distinct run, scheduler from runs where scheduler in ('hire', 'k8-resubmit') and mu = 0.25", "runs")
def d3_filter_runs(spark: SparkSession, sf: str) -> DataFrame:
    config = sweeps.normalize_config(_config(spark, sf))
    chosen = sweeps.filter_runs(config, sweeps.parse_filter("scheduler=hire:scheduler=k8-resubmit:mu=0.25"))
    return sweeps.attach_config(chosen, config, ["scheduler"]).select("run", "scheduler")


@query(f"with {LONG} select run, key, value from config where key not in ('seed', 'cell')", "runs")
def d4_drop_config(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.drop_config(sweeps.normalize_config(_config(spark, sf)), ["seed", "cell"]).select("run", "key", "value")


@query(f"with {LONG} select key, count(distinct value) as values from config group by key having count(distinct value) > 1 or key = 'scheduler'", "runs")
def d5_find_sweeps(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.find_sweeps(sweeps.normalize_config(_config(spark, sf)))


@query("select run, Time, CountJobs, scheduler, cast(mu as varchar) as mu from counters", "counters")
def d6_attach_config(spark: SparkSession, sf: str) -> DataFrame:
    stats = view(spark, sf, "counters").select("experiment", "run", "Time", "CountJobs")
    return sweeps.attach_config(stats, sweeps.normalize_config(_config(spark, sf)), ["scheduler", "mu"]).drop("experiment")


@query(
    """select run, Time, CountJobs, cast(mu * 2 as double) as "mu-inp", cast(run as bigint) as "cell-k", run % 2 = 0 as "kappa-draw-random", case when run < 3 then cast(run as bigint) * 1000 end as "sim-time" from counters""",
    "counters",
)
def d6_attach_typed_config(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and truth values of configurations come as such; what is no number is null."""
    stats = view(spark, sf, "counters").select("experiment", "run", "Time", "CountJobs")
    told = {
        "mu-inp": (F.col("mu") * 2).cast("string"), "cell-k": F.col("run").cast("string"), "kappa-draw-random": F.when(F.col("run") % 2 == 0, "True").otherwise("no"),
        "sim-time": F.when(F.col("run") < 3, (F.col("run") * 1000).cast("string")).otherwise("as long as it takes"),
    }
    pairs = F.explode(F.create_map(*[x for k, v in told.items() for x in (F.lit(f"--{k}"), v)])).alias("key", "value")
    config = view(spark, sf, "runs").select("experiment", "run", "mu").distinct().select("experiment", "run", pairs)
    return sweeps.attach_config(stats, sweeps.normalize_config(config), list(told)).drop("experiment")


@query("select run, count(*) as rows, max(CountJobs) as jobs from counters where Time >= 3600000 group by run", "counters")
def d7_apply_mappers(spark: SparkSession, sf: str) -> DataFrame:
    """A mapper on DataFrames, then one on each run's rows in pandas."""
    rows = sweeps.apply_mappers(view(spark, sf, "counters"), [lambda d: mappers.after(d, 3_600_000)], ["experiment", "run", "CountJobs"])

    def count(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run": [part["run"].iloc[0]], "rows": [len(part)], "jobs": [part["CountJobs"].max()]})

    return sweeps.map_runs_in_pandas(rows, count, "run int, rows long, jobs long")


@query("select run, Time, case when run < 3 then CountJobs end as CountJobs, case when run >= 3 then CountPreemptions end as CountPreemptions from counters", "counters")
def d8_union_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "counters")
    return sweeps.union_runs([rows.where("run < 3").select("run", "Time", "CountJobs"), rows.where("run >= 3").select("run", "Time", "CountPreemptions")])


@query("select run, Time, CountJobs, CountPreemptions, ['hire', 'k8-resubmit', 'yarn-greedy'][run % 3 + 1] as scheduler, case when run % 2 = 0 then '0.25' else '0.5' end as mu, ['hire', 'resubmit', 'greedy'][run % 3 + 1] as strategy from counters where run <> 5 and run % 2 = 0", "counters")
def d9_load_experiments(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = load_experiments(spark, [run_directories(spark, sf)], "scheduler", {"mu": ["0.25"]}, keep=["mu"], schema=SCHEMA)
    return rows.drop("experiment").withColumnRenamed("scheduler-strategy", "strategy")


@query("with p as (select * from (select distinct scheduler from runs) cross join (select distinct mu from runs) cross join (select distinct event_type from runs)) select scheduler, mu, event_type, count(run) as rows from p left join runs using (scheduler, mu, event_type) group by all", "runs")
def d10_sweep_points(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.sweep_points(view(spark, sf, "runs"), ["scheduler", "mu", "event_type"])


@query("select s as scheduler, cast(m as double) as mu from (select unnest(['hire', 'k8-resubmit', 'yarn-greedy', 'sparrow']) as s) cross join (select unnest([0.25, 0.5, 0.75]) as m) where not (s = 'sparrow' and m > 0.5) and (s, m) not in (select scheduler, mu from runs)", "runs")
def d11_sweep_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Planned combinations that no run of the view has."""
    names = spark.createDataFrame([(x,) for x in (*SCHEDULERS, "sparrow")], "scheduler string")
    shares = spark.createDataFrame([(x,) for x in (0.25, 0.5, 0.75)], "mu double")
    planned = sweeps.planned_runs([names, shares], (F.col("scheduler") == "sparrow") & (F.col("mu") > 0.5))
    return sweeps.sweep_coverage(planned, view(spark, sf, "runs"), ["scheduler", "mu"]).select("scheduler", "mu")


PLAN = """plan as (select s as scheduler, m as mu_inp, r as mode, k as kappa, c as searched, u as simple, (dense_rank() over (order by s) - 1) * 48 + (dense_rank() over (order by m) - 1) * 16 + (dense_rank() over (order by r) - 1) * 8 + (dense_rank() over (order by k) - 1) * 4 + (dense_rank() over (order by c) - 1) * 2 + (dense_rank() over (order by u) - 1) as run
from (select distinct concat(scheduler, t) as s from runs, (select unnest(['', ',force-inp', ',force-server']) as t)), (select distinct cast(mu as double) as m from runs union all select 0.0), (select unnest(['foreach', 'once']) as r), (select unnest([1, 2]) as k), (select unnest([10, 20]) as c), (select unnest([false, true]) as u))"""


@query(
    f"""with {PLAN}, w as (select *, case when contains(scheduler, ',force-inp') or contains(scheduler, ',resubmit') or contains(scheduler, ',fallback') then mu_inp = 0 and not contains(scheduler, 'coco') else false end as r1, contains(scheduler, 'hire') as h from plan)
select run, scheduler, mu_inp, mode, case when r1 then 'in-network strategy without in-network load' when h and mode = 'foreach' then 'hire with shared resources for each' when not h and mode = 'once' then 'others with shared resources once' when not h and not simple then 'others with complex flavors'
when contains(scheduler, ',force-server') and mu_inp > 0 then 'server strategy with in-network load' when mu_inp = 0 and kappa <> 1 then 'in-network key without in-network load' when not h and searched <> 10 then 'hire''s key for others' end as reason from w""",
    "runs",
)
def d11_skip_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All combinations of a plan over the view's schedulers and shares, with the rule that leaves a number empty."""
    runs = view(spark, sf, "runs")
    one = lambda values, name, kind: spark.createDataFrame([(x,) for x in values], f"`{name}` {kind}")
    names = runs.select(F.explode(F.array(*[F.concat("scheduler", F.lit(t)) for t in ("", ",force-inp", ",force-server")])).alias("scheduler")).distinct()
    shares = runs.select(F.col("mu").cast("double").alias("mu-inp")).distinct().unionByName(one([0.0], "mu-inp", "double"))
    frames = [names, shares, one(["foreach", "once"], "shared-resource-mode", "string"), one([1, 2], "kappa-tasks", "int"), one([10, 20], "hireShortcutsMaxSelection", "int"), one([False, True], "useSimpleTwoStateInpServerFlavorOptions", "boolean")]
    planned = sweeps.planned_runs(frames).drop("skipped")
    out = sweeps.with_skips(planned, {"kappa-tasks": 1, "hireShortcutsMaxSelection": 10})
    return out.select("run", "scheduler", F.col("mu-inp").alias("mu_inp"), F.col("shared-resource-mode").alias("mode"), "reason")


@query("select run, Time, unnest(['CountJobs', 'CountPreemptions']) as origin_column, unnest([CountJobs, CountPreemptions]) as y from counters", "counters")
def f1_melt(spark: SparkSession, sf: str) -> DataFrame:
    return figures.melt(view(spark, sf, "counters"), ["run", "Time"], ["CountJobs", "CountPreemptions"])


@query("select scheduler, mu, round(avg(value), 4) as mean, round(avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 4) as low, round(avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 4) as high from runs group by 1, 2", "runs")
def f2_mean_band_normal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(figures.mean_band(view(spark, sf, "runs"), ["scheduler", "mu"], "value", ["event_id"], method="normal"))


def f2_mean_band_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return figures.mean_band(view(spark, sf, "runs"), ["scheduler", "mu"], "value", ["event_id"])


query()(f2_mean_band_bootstrap)


@query(
    """with f as (select scheduler, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75, min(value) as lo, max(value) as hi, count(*) as n, stddev_samp(value) as s from runs group by 1),
c as (select scheduler, least(999, floor((value - lo) / ((hi - lo) / 1000))) as c, count(*) as k from runs join f using (scheduler) group by 1, 2), g as (select *, lo + i * (hi - lo) / 99 as x from f, (select unnest(range(100)) as i))
select scheduler, round(any_value(p25), 4) as p25, round(any_value(p50), 4) as p50, round(any_value(p75), 4) as p75, round(x, 4) as at, round(sum(k * exp(-pow((x - lo - (c + 0.5) * (hi - lo) / 1000) / (s * pow(n, -0.2)), 2) / 2)) / max(n * s * pow(n, -0.2)) / 2.5066282746310002, 6) as density from g join c using (scheduler) group by scheduler, x""",
    "runs",
)
def f3_violin_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = figures.violin_stats(view(spark, sf, "runs"), ["scheduler"], "value")
    return out.withColumns({c: F.round(c, 4) for c in ("p25", "p50", "p75", "at")} | {"density": F.round("density", 6)})


@query("select scheduler, case scheduler when 'hire' then 'Hire' when 'k8-resubmit' then 'K8' else scheduler end as label, case scheduler when 'hire' then 0 when 'k8-resubmit' then 1 else 2 end as place, scheduler <> 'yarn-greedy' as known, count(*) as rows from runs group by 1", "runs")
def f4_label_series(spark: SparkSession, sf: str) -> DataFrame:
    out = figures.label_series(view(spark, sf, "runs"), "scheduler", {"hire": "Hire", "k8-resubmit": "K8"})
    return out.groupBy("scheduler", "label", F.col("order").alias("place"), "known").agg(F.count("*").alias("rows"))


@query("select run, Time, mu * 100 as mu from counters", "counters")
def f5_scale_percent(spark: SparkSession, sf: str) -> DataFrame:
    return figures.scale_percent(view(spark, sf, "counters").select("run", "Time", "mu"), "mu")


@query(
    """with l as (select scheduler, mu, 100.0 * TotalJobsFullyScheduledINP / (1 + CountJobsWithInp) as a, CountPreemptions as p from counters qualify Time = max(Time) over (partition by experiment, run)), m as (select scheduler, mu, 'AllocatedIncSuccess' as origin_column, a as y from l union all select scheduler, mu, 'CountPreemptions', p from l)
select scheduler, mu * 100 as mu, origin_column, round(avg(y), 4) as mean, round(avg(y) - coalesce(1.959963984540054 * stddev_samp(y) / sqrt(count(*)), 0), 4) as low, round(avg(y) + coalesce(1.959963984540054 * stddev_samp(y) / sqrt(count(*)), 0), 4) as high from m group by all""",
    "counters",
)
def f6_inc_success(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(paper_frames.inc_success(view(spark, sf, "counters")))


@query(
    """with tg as (select experiment, run, 100.0 * count(*) filter (where FlavorInp = 'Y' and JobStatus <> 'W') / nullif(count(*) filter (where FlavorInp in ('Y', 'N')), 0) as t from taskgroups where strategy = 'hire' group by 1, 2), j as (select experiment, run, mu, 100.0 * TotalJobsFullyScheduledINP / (1 + CountJobsWithInp) as j from counters qualify Time = max(Time) over (partition by experiment, run))
select mu, round(avg(100 - t), 4) as TgNotAllocated, round(avg(100 - j), 4) as JobNotAllocated from tg join j using (experiment, run) group by mu""",
    "taskgroups",
    "counters",
)
def f6_tg_not_allocated(spark: SparkSession, sf: str) -> DataFrame:
    tgs = view(spark, sf, "taskgroups").withColumnRenamed("strategy", "scheduler-strategy")
    return rounded(paper_frames.tg_not_allocated(tgs, view(spark, sf, "counters")))


@query(
    """with r as (select scheduler, mu, AvgQueueing as v from taskgroups where JobStatus <> 'W' and TotalTasks = TasksStarted and TaskGroupType = 'I')
select scheduler, mu, count(v) as count, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, round(min(v), 4) as min, round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.75), 4) as p75, round(max(v), 4) as max from r group by 1, 2""",
    "taskgroups",
)
def f6_locality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(paper_frames.locality(view(spark, sf, "taskgroups").withColumn("InvolvedRacks", F.col("AvgQueueing"))))


@query(
    f"""with {INC_VIEW}, a as (select experiment, run, Time, 100 * (1 - ((1 - u1 - b1) * t1 + (1 - u2 - b2) * t2) / (t1 + t2 + 0.01)) as s0, 100 * (1 - ((1 - (u1 + b1) / 2) * t1 / 2 + (1 - (u2 + b2) / 2) * t2 / 2) / ((t1 + t2) / 2 + 0.01)) as s1 from wide),
b as (select experiment, run, Time, 100 * (CountJobs % 11) / 11.0 as v0, 100 * (CountPreemptions % 5) / 5.0 as v1 from counters), j as (select * from a join b using (experiment, run, Time)),
m as (select 'SwitchDim0' as origin_column, s0 as y from j union all select 'SwitchDim1', s1 from j union all select 'ServerDim0', v0 from j union all select 'ServerDim1', v1 from j)
select origin_column, count(y) as count, round(avg(y), 4) as mean, round(stddev_samp(y), 4) as std, round(min(y), 4) as min, round(quantile_cont(y, 0.25), 4) as p25, round(quantile_cont(y, 0.5), 4) as p50, round(quantile_cont(y, 0.75), 4) as p75, round(max(y), 4) as max from m group by 1""",
    "counters",
)
def f6_load_by_dim(spark: SparkSession, sf: str) -> DataFrame:
    cell = view(spark, sf, "counters").select("experiment", "run", "scheduler", "Time", (F.col("CountJobs") % 11 / 11).alias("UtilizationServersDim0"), (F.col("CountPreemptions") % 5 / 5).alias("UtilizationServersDim1"))
    inc = inc_wide(spark, sf).withColumns({c.replace("Dim0", "Dim1"): F.col(c) / 2 for c in inc_wide(spark, sf).columns if "Dim0" in c})
    return rounded(paper_frames.load_by_dim(inc, cell, dims=2))


@query(
    """with e as (select mu, (EndTimeNanos - StartTimeNanos) / 1000000 as x from solver join (select distinct run, mu from runs) using (run)), s as (select min(log10(x)) filter (where x > 0) as low, max(log10(x)) filter (where x > 0) as high from e),
c as (select mu, cast(case when x <= 0 then 0 else least(98, floor((log10(x) - low) / (high - low) * 99 + 1e-9)) end as int) as bin, count(*) as n from e, s group by 1, 2), d as (select mu, bin, low, high, coalesce(n, 0) as m from (select * from (select distinct mu from e), (select unnest(range(99))::int as bin), s) left join c using (mu, bin))
select mu, bin, round(pow(10, low + bin * (high - low) / 99), 4) as edge, round(sum(m) over (partition by mu order by bin) / sum(m) over (partition by mu), 2) as cdf, round(1 - sum(m) over (partition by mu order by bin) / sum(m) over (partition by mu), 2) as ccdf from d""",
    "runs",
    "solver",
)
def f6_solver_cdf(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "runs").select("run", "mu").distinct()
    out = paper_frames.solver_cdf(view(spark, sf, "solver").join(F.broadcast(runs), "run"))
    return out.withColumns({"edge": F.round("edge", 4), "cdf": F.round("cdf", 2), "ccdf": F.round("ccdf", 2)})


def _raw(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.csv(path)
    return path


@query("select concat('m', user_id) as machine_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as time_stamp, cast(user_id % 5 as int) as cpu_num, case when event_id % 3 = 0 then 'BROKEN' else event_type end as status from events where event_id % 7 > 0")
def s1_read_machine_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Machines written as a raw file; rows without a number of CPUs go to the rejects."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    status = F.when(F.col("event_id") % 3 == 0, "BROKEN").otherwise(F.col("event_type"))
    cpus = F.when(F.col("event_id") % 7 > 0, (F.col("user_id") % 5).cast("string")).otherwise("many")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("m"), "user_id"), seconds, F.lit("f1"), F.lit("f2"), cpus, F.col("value"), status)
    good, _ = trace.read_machine_meta(spark, _raw(spark, rows, "machine_meta"))
    return good.select("machine_id", "time_stamp", "cpu_num", "status")


@query("select container_id, app_du, status, time_stamp, cpu_request, case when cpu_request = 0 then null else cpu_request end as cpu_limit, round(mem_size, 4) as mem_size from container_rows", "container_rows")
def s2_read_container_meta(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.when(F.col("cpu_request") > 0, F.col("cpu_request"))
    rows = view(spark, sf, "container_rows").select("container_id", F.lit("m1"), "time_stamp", "app_du", "status", "cpu_request", limit, "mem_size")
    good, _ = trace.read_container_meta(spark, _raw(spark, rows, "container_meta"))
    return rounded(good.select("container_id", "app_du", "status", "time_stamp", "cpu_request", "cpu_limit", "mem_size"))


@query("select job, name, instances, round(cpu, 4) as cpu, round(mem, 4) as mem, start_time, end_time from task_rows where end_time - start_time < 100000000 union all select 'rejected', 'time', count(*), null, null, null, null from task_rows where end_time - start_time >= 100000000", "task_rows")
def s3_read_batch_task(spark: SparkSession, sf: str) -> DataFrame:
    """Task rows, empty fields among them, and the number of rejects: some have a negative end."""
    end = F.when(F.col("end_time") - F.col("start_time") < 100_000_000, F.col("end_time")).otherwise(-1)
    rows = view(spark, sf, "task_rows").select("name", "instances", "job", "type", F.lit("Terminated"), "start_time", end, "cpu", "mem")
    good, rejects = trace.read_batch_task(spark, _raw(spark, rows, "batch_task"))
    good = rounded(good.select(F.col("job_name").alias("job"), F.col("task_name").alias("name"), F.col("instance_num").alias("instances"), F.col("plan_cpu").alias("cpu"), F.col("plan_mem").alias("mem"), "start_time", "end_time"))
    none = lambda kind: F.lit(None).cast(kind)
    lost = rejects.agg(F.count("*").alias("instances")).select(F.lit("rejected").alias("job"), F.lit("time").alias("name"), "instances", none("double").alias("cpu"), none("double").alias("mem"), none("bigint").alias("start_time"), none("bigint").alias("end_time"))
    return good.unionByName(lost)


@query("select distinct user_id as src, cast(user_id % 2 = 0 as boolean) as src_is_switch, user_id % 9 as dst, true as dst_is_switch from events")
def s11_read_topology_edges(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "edges")
    u = F.col("user_id")
    spark.read.parquet(f"{sf}/events.parquet").select(u.alias("src"), (u % 2 == 0).alias("src_is_switch"), (u % 9).alias("dst"), F.lit(True).alias("dst_is_switch")).distinct().write.option("header", True).csv(path)
    return topology.read_topology_edges(spark, path)
