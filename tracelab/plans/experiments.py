"""Loading of experiments: configurations first, statistics of the runs that remain in one scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tracelab.operators import sweeps
from tracelab.sources import runs as source


def load_experiments(
    spark: SparkSession,
    roots: Sequence[str],
    kind: str,
    wanted: Mapping[str, Sequence[str]] | None = None,
    ignore: Sequence[str] = (),
    keep: Sequence[str] = (),
    mappers: Sequence[Callable[[DataFrame], DataFrame]] = (),
    require_done: bool = True,
    drop_seed: bool = True,
    schema: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """(rows with their sweep columns, names of those): runs that pass the filter, and their statistics after the mappers."""
    found = source.discover_runs(spark, roots, require_done)
    config = sweeps.normalize_config(source.read_run_configs(spark, roots).join(found.select("run_dir"), "run_dir", "left_semi"), drop_seed=False)
    config = sweeps.with_family(config)
    chosen = sweeps.filter_runs(config, wanted or {})
    config = sweeps.drop_config(config.join(chosen, sweeps.RUN, "left_semi"), [*ignore, *(["seed"] if drop_seed else [])])
    names = sorted({r.key for r in sweeps.find_sweeps(config).collect()} | set(keep))  # names of keys
    stats = source.read_stats(spark, roots, kind, found, schema).drop("run_dir").join(chosen, sweeps.RUN, "left_semi")
    rows = sweeps.attach_config(stats, config, [*names, *(["scheduler-strategy"] if "scheduler-strategy" not in names else [])])
    return sweeps.apply_mappers(rows, mappers), names
