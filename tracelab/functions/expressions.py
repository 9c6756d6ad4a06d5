"""Expressions that operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the trace: states of machines, and whether a machine in them can be used.
MACHINE_STATUS = {"USING": True, "IMPORT_INSTALLING": False}


def map_status(status: Column, mapping: dict[str, bool] = MACHINE_STATUS) -> Column:
    """The mapped value, null for a state that isn't known."""
    return reduce(lambda out, kv: out.when(status == kv[0], F.lit(kv[1])), list(mapping.items())[1:], F.when(status == next(iter(mapping)), F.lit(mapping[next(iter(mapping))])))


#: Forms of task names in the trace. Independent ones, and those with a number, numbers of others and a stage.
INDEPENDENT = r"^(task_\S*|MergeTask)\z"
DEPENDENT = r"^[a-zA-Z]+[0-9]+_?(_[0-9]+)*_?(Stg[0-9]+)?\z"


def parse_task_name(name: Column, deps: str = "last") -> Column:
    """struct(name, prefix, deps) of a batch task's name, null where it has no known form.

    Independent tasks keep their name and have neither prefix nor dependencies. deps="last" keeps the last
    number only, "all" all of them.
    """
    numbers = F.filter(F.split(F.regexp_extract(name, r"^[a-zA-Z]+[0-9]+((?:_[0-9]+)*)", 1), "_"), lambda x: x != "").cast("array<int>")
    numbers = numbers if deps == "all" else F.slice(numbers, F.greatest(F.lit(1), F.size(numbers)), 1)
    alone = F.struct(name.alias("name"), F.lit(None).cast("string").alias("prefix"), F.array().cast("array<int>").alias("deps"))
    prefix = F.regexp_extract(name, r"^([a-zA-Z]+)[0-9]", 1)
    tied = F.struct(F.regexp_extract(name, r"^[a-zA-Z]+[0-9]+", 0).alias("name"), prefix.alias("prefix"), numbers.alias("deps"))
    return F.when(name.rlike(INDEPENDENT), alone).when(name.rlike(DEPENDENT), tied)


def ms_to_human(ms: Column) -> Column:
    """h:mm:ss.SSS"""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def switch_resources(recirculation: Column, stages: Column, sram: Column, most: int) -> Column:
    """Demand in switch units: percent of recirculation, of 48 stages and of 22 MB, in whole units."""
    return F.array(F.floor(F.floor(recirculation * most) / 100), F.floor(F.floor(stages) * most / 48), F.floor(F.floor(sram * most) / 22)).cast("array<bigint>")


def kappa_reduce(x: Column, k: float, unit: Column | None = None, least: float = 0.8) -> Column:
    """ceil(x * share): the share is max(k, least), or drawn between that and 1 by a unit column."""
    k = max(k, least)
    return F.ceil(x * (unit * (1 - k) + k if unit is not None else F.lit(k if unit is None else 1.0))).cast("bigint")


def hash_unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def capped_share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """scale * part / whole; null where whole is 0."""
    return F.try_divide(F.lit(scale) * part, whole)


def scheduler_family(scheduler: Column) -> Column:
    """The first of hire, resubmit and greedy that the name holds, else unknown."""
    return reduce(lambda rest, x: F.when(scheduler.contains(x), x).otherwise(rest), ("greedy", "resubmit", "hire"), F.lit("unknown"))


def might_be_in_flavor(in_option: Column, not_in: Column, chosen: Column, excluded: Column) -> Column:
    """A group that can still belong to the flavor: it rules nothing out, or nothing of that is chosen and none of its options is excluded."""
    return (F.size(not_in) == 0) | (~F.arrays_overlap(not_in, chosen) & ~F.arrays_overlap(in_option, excluded))


def definitely_in_flavor(in_option: Column, not_in: Column, chosen: Column, excluded: Column) -> Column:
    """A group that does belong to it: it rules nothing out, or one of its options is chosen, none excluded, and all that it rules out is excluded, nothing of it chosen."""
    settled = F.arrays_overlap(in_option, chosen) & (F.size(F.array_except(not_in, excluded)) == 0)
    return (F.size(not_in) == 0) | (settled & ~F.arrays_overlap(not_in, chosen) & ~F.arrays_overlap(in_option, excluded))


def inc_options(options: Column) -> Column:
    """Whether any option is that of an in-network flavor: an even bit above 0."""
    return F.exists(options, lambda x: (x > 0) & (x % 2 == 0))


def load_level(free: Column, most: Column, scaling: int) -> Column:
    """Used share of a resource in whole steps of 1/scaling."""
    return F.when(most > 0, F.floor(F.lit(scaling) * (most - free) / most)).otherwise(0).cast("bigint")
