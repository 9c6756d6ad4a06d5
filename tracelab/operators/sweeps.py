"""Configurations of runs, and sweeps: keys that take more than one value.

Configurations are long: (experiment, run, key, value) with values as text, so that keys needn't be known.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.expressions import scheduler_family

RUN = ["experiment", "run"]
#: Keys that say where and when a run ran, not how.
DROPPED = ("id", "output-dir")

#: Configuration keys that aren't text.
TYPES = {
    **dict.fromkeys(("sim-time", "statistics-interval", "max-server-capacity", "cell-k", "cell-max-active-inp"), "bigint"),
    **dict.fromkeys(("mu-inp", "think-time-scaling"), "double"),
    **dict.fromkeys(
        (
            "flow-scheduler-take-real-think-time", "hirePreventHighLoadSolver", "hirePropagateDownstreamServerLocality", "kappa-draw-random", "hirePostponePreemptionOnFeasibleJobAllocation", "hirePostponePreemptionOnOverloadedCell",
            "useSimpleTwoStateInpServerFlavorOptions",
        ),
        "boolean",
    ),
}


def normalize_config(config: DataFrame, drop_seed: bool = False) -> DataFrame:
    """Keys without leading dashes, without ids and paths; truth values in lower case."""
    key = F.regexp_replace("key", "^-+", "")
    value = F.when(F.lower("value").isin("true", "false"), F.lower("value")).otherwise(F.col("value"))
    out = config.withColumns({"key": key, "value": value})
    return out.where(~F.col("key").isin(*DROPPED, *(["seed"] if drop_seed else [])))


def with_family(config: DataFrame) -> DataFrame:
    """config with scheduler-strategy, and the simple-flavor mark on the scheduler's name; a missing flavor flag is true."""
    wide = config.where(F.col("key").isin("scheduler", "use-simple-flavor")).groupBy(*RUN).pivot("key", ["scheduler", "use-simple-flavor"]).agg(F.first("value"))
    named = wide.where("scheduler is not null").select(*RUN, F.concat("scheduler", F.when(F.coalesce("use-simple-flavor", F.lit("true")) == "true", "--simple-flavor").otherwise("")).alias("name"), scheduler_family(F.col("scheduler")).alias("family"))
    more = named.select(*RUN, F.explode(F.create_map(F.lit("scheduler"), "name", F.lit("scheduler-strategy"), "family")).alias("key", "value"))
    return config.where(~F.col("key").isin("scheduler", "scheduler-strategy")).select(*RUN, "key", "value").unionByName(more).unionByName(config.where("key = 'scheduler'").join(named, RUN, "left_anti").select(*RUN, "key", "value"))


def parse_filter(text: str) -> dict[str, list[str]]:
    """k=v:k=v2:k2=v3 as values by key."""
    out: dict[str, list[str]] = {}
    for part in filter(None, text.split(":")):
        key, _, value = part.partition("=")
        out.setdefault(key, []).append(value)
    return out


def filter_runs(config: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """(experiment, run) of the runs that have every key with one of its values."""
    hit = reduce(lambda a, b: a | b, [(F.col("key") == k) & F.col("value").isin(*map(str, v)) for k, v in wanted.items()], F.lit(False))
    runs = config.where(hit).groupBy(*RUN).agg(F.count_distinct("key").alias("n")) if wanted else config.groupBy(*RUN).agg(F.lit(0).alias("n"))
    return runs.where(F.col("n") == len(wanted)).select(*RUN)


def drop_config(config: DataFrame, keys: Sequence[str]) -> DataFrame:
    return config.where(~F.col("key").isin(*keys)) if keys else config


def find_sweeps(config: DataFrame, always: Sequence[str] = ("scheduler",), never: Sequence[str] = ("run", "experiment", "scheduler-strategy")) -> DataFrame:
    """(key, values): keys with more than one value, and those that always count."""
    counts = config.where(~F.col("key").isin(*never)).groupBy("key").agg(F.count_distinct("value").alias("values"))
    return counts.where((F.col("values") > 1) | F.col("key").isin(*always))


def typed(c: str, types: Mapping[str, str] = TYPES) -> Column:
    """A configuration's text by the type of its name: a truth value is true or else false, what is no number is null."""
    if types.get(c) == "boolean":
        return (F.lower(f"`{c}`") == "true").alias(c)
    return (F.col(f"`{c}`").try_cast(types[c]) if c in types else F.col(f"`{c}`")).alias(c)


def attach_config(stats: DataFrame, config: DataFrame, keys: Sequence[str], types: Mapping[str, str] = TYPES) -> DataFrame:
    """stats with the keys as columns of their types. A key that stats has already is an error. Configurations are a row a run and are small."""
    if clash := set(keys) & set(stats.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    wide = config.where(F.col("key").isin(*keys)).groupBy(*RUN).pivot("key", list(keys)).agg(F.first("value"))
    return stats.join(wide.select(*RUN, *[typed(c, types) for c in keys]), RUN)


def apply_mappers(df: DataFrame, mappers: Sequence[Callable[[DataFrame], DataFrame]], keep: Sequence[str] | None = None) -> DataFrame:
    out = reduce(lambda d, f: d.transform(f), mappers, df)
    return out if keep is None else out.select(*[c for c in keep if c in out.columns])


def map_runs_in_pandas(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each run's rows at once; a run must fit a task."""
    return df.groupBy(*RUN).applyInPandas(fn, schema)


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sweep_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every combination of the columns' values with its number of rows, 0 for those that don't occur. Bounded by the configurations' values."""
    grid = reduce(lambda a, b: a.crossJoin(b), [df.select(c).distinct() for c in cols])
    return grid.join(df.groupBy(*cols).agg(F.count("*").alias("rows")), list(cols), "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def for_each_point(df: DataFrame, cols: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over the rows of each combination, all in one job."""
    return df.groupBy(*cols).applyInPandas(fn, schema)


def planned_runs(frames: Sequence[DataFrame], skip=None) -> DataFrame:
    """The product of parameter frames (one column each, of planned values) with run, numbered in the order of the values; useless combinations keep their number but are marked skipped."""
    frames = [f.coalesce(1) for f in frames]  # a few values each; their product would multiply partitions
    grid = reduce(lambda a, b: a.crossJoin(b), frames)
    cols = grid.columns
    sizes = [f.count() for f in frames]  # planned values
    place = F.lit(0)
    for k, c in enumerate(cols):
        rank = frames[k].select(c, (F.expr(f"row_number() over (order by `{c}`)") - 1).alias(f"_{c}"))
        grid = grid.join(F.broadcast(rank), c)
        stride = 1
        for n in sizes[k + 1 :]:
            stride *= n
        place = place + F.col(f"_{c}") * stride
    return grid.select(*cols, place.cast("bigint").alias("run"), (skip if skip is not None else F.lit(False)).alias("skipped"))


#: Strategies that need in-network load, that which must not have any, and keys whose sweep means nothing without in-network load, or without the scheduler that they belong to.
INC_STRATEGIES, SERVER_STRATEGY = (",force-inp", ",resubmit", ",fallback"), ",force-server"
INC_KEYS = ("cell-max-active-inp", "scale-cell-switches", "kappa-tasks", "maxInpFlavorDecisionsPerRound", "kappa-runtime", "cellSwitchHomogeneous")
HIRE_KEYS = ("hireShortcutsMaxSearchSpace", "hireShortcutsMaxSelection")

#: Useless combinations: name, columns that must be swept or set, condition as SQL over them. A key that isn't a column has one value everywhere.
_INC = " or ".join(f"contains(scheduler, '{x}')" for x in INC_STRATEGIES)
SKIP_RULES = (
    ("in-network strategy without in-network load", ("scheduler", "mu-inp"), f"({_INC}) and `mu-inp` = 0 and not contains(scheduler, 'coco')"),
    ("penalties out of order", ("hireInpServerPenaltyWaitingLower", "hireInpServerPenaltyWaitingUpper"), "hireInpServerPenaltyWaitingLower >= hireInpServerPenaltyWaitingUpper"),
    ("hire with shared resources for each", ("scheduler", "shared-resource-mode"), "contains(scheduler, 'hire') and `shared-resource-mode` = 'foreach'"),
    ("others with shared resources once", ("scheduler", "shared-resource-mode"), "not contains(scheduler, 'hire') and `shared-resource-mode` = 'once'"),
    ("others with complex flavors", ("scheduler", "useSimpleTwoStateInpServerFlavorOptions"), "not contains(scheduler, 'hire') and not useSimpleTwoStateInpServerFlavorOptions"),
    ("server strategy with in-network load", ("scheduler", "mu-inp"), f"contains(scheduler, '{SERVER_STRATEGY}') and `mu-inp` > 0"),
    *(("in-network key without in-network load", ("mu-inp", k), f"`mu-inp` = 0 and `{k}` is distinct from `first:{k}`") for k in INC_KEYS),
    *(("hire's key for others", ("scheduler", k), f"not contains(scheduler, 'hire') and `{k}` is distinct from `first:{k}`") for k in HIRE_KEYS),
)


def with_skips(grid: DataFrame, first: Mapping[str, object] | None = None, rules: Sequence[tuple[str, Sequence[str], str]] = SKIP_RULES) -> DataFrame:
    """grid with two more columns: `skipped`, and `reason`, the first rule that a combination breaks. Skipped ones keep their number, so their directories stay empty.

    Columns of the grid are keys without dashes. first: the configuration that a plan begins with, which tells what a key is where it isn't swept.
    """
    first = {k: v for k, v in (first or {}).items() if k in grid.columns}
    told = grid.withColumns({f"first:{k}": F.lit(v) for k, v in first.items()})
    met = [F.when(F.expr(sql), name) for name, keys, sql in rules if all(k in grid.columns for k in keys) and all(k in first for k in keys if f"`first:{k}`" in sql)]
    reason = F.coalesce(*met, F.lit(None).cast("string"))
    return told.withColumn("reason", reason).withColumn("skipped", F.col("reason").isNotNull()).drop(*[f"first:{k}" for k in first])


def sweep_coverage(planned: DataFrame, done: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Planned combinations that aren't skipped and have no run."""
    return planned.where("not skipped").join(done.select(*cols).distinct(), list(cols), "left_anti")
