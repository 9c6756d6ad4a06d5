"""Run directories: roots hold run-N directories with config.json, START and DONE markers and statistics as CSV files or in stats.zip."""

from __future__ import annotations

import csv
import io
import re
import warnings
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelab import schemas

_RUN = r"^(.*?([^/]+)/run-([0-9]+))/"


def run_of(path: Column) -> list[Column]:
    """run_dir, experiment (its root's name) and run of a file's path."""
    return [F.regexp_replace(F.regexp_extract(path, _RUN, 1), "^file:/+", "file:/").alias("run_dir"), F.regexp_extract(path, _RUN, 2).alias("experiment"), F.regexp_extract(path, _RUN, 3).try_cast("int").alias("run")]


def _names(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """Names of all files under the roots, empty ones included; some ten a run. No file is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)).inputFiles()


def _globs(spark: SparkSession, roots: Sequence[str], file: str) -> list[str]:
    """A pattern for each root in which a run has the file. Names come as parts of URLs."""
    hits = [re.match(rf"(.*)/run-[0-9]+/{re.escape(file)}(?:/|$)", n) for n in _names(spark, roots)]
    return sorted({f"{unquote(m[1])}/run-*/{file}" for m in hits if m})


def discover_runs(spark: SparkSession, roots: Sequence[str], require_done: bool = True) -> DataFrame:
    """(run_dir, experiment, run, done): runs that were started and, unless told otherwise, are done.

    Markers may be empty files.
    """
    files = spark.createDataFrame([(n,) for n in _names(spark, roots)], "path string")
    marks = files.select(*run_of(F.col("path")), F.regexp_extract("path", r"/run-[0-9]+/(START|DONE)(?:/|$)", 1).alias("mark")).where("run_dir <> '' and mark <> ''")
    runs = marks.groupBy("run_dir", "experiment", "run").agg(F.bool_or(F.col("mark") == "START").alias("started"), F.bool_or(F.col("mark") == "DONE").alias("done"))
    runs = runs.where("started").drop("started")
    return runs.where("done") if require_done else runs


def read_run_configs(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(run_dir, experiment, run, key, value): configurations, one row a key, values as text."""
    text = spark.read.text(_globs(spark, roots, "config.json"), wholetext=True).select(*run_of(F.col("_metadata.file_path")), "value")
    return text.select("run_dir", "experiment", "run", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def stats_schema(kind: str) -> str:
    return schemas.cell_inp() if kind == "cell-inp" else schemas.STATS[kind]


def _places(columns: Sequence[str], header: Sequence[str], kind: str) -> list[int | None]:
    """Where each column is in the header (none: missing). Others in the header are warned of."""
    at = {c.strip(): k for k, c in reversed(list(enumerate(header)))}
    unknown = sorted(at.keys() - set(columns))
    if len(unknown) == len(at):
        raise ValueError(f"{kind}: no known column in {', '.join(header)}")
    if unknown:
        warnings.warn(f"{kind}: columns that aren't read: {', '.join(unknown)}", stacklevel=3)
    return [at.get(c) for c in columns]


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first line. Empty files have none."""
    lines = spark.read.text(list(paths)).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("k"))
    first = lines.groupBy("path").agg(F.min_by("value", "k").alias("header"))
    return {r.header: [unquote(x) for x in r.paths] for r in first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}  # some ten names a run, as in _names


def read_stats(spark: SparkSession, roots: Sequence[str], kind: str, runs: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """One kind of statistics of all runs, with run_dir, experiment and run; of the given runs only, where they are given.

    Columns are found by their names in each file's header, in any order; one scan for each different header. Columns that
    a file doesn't have are null, others than the schema's are warned of. Files that are empty or missing give no rows;
    short rows end in nulls, values of another type are null.
    """
    schema, paths = schema or stats_schema(kind), _globs(spark, roots, f"{kind}.csv")
    fields = StructType.fromDDL(schema).fields
    rows = spark.createDataFrame([], f"run_dir string, experiment string, run int, {schema}")
    for header, files in sorted(_headers(spark, paths).items()) if paths else []:
        names = next(csv.reader([header]), [])
        text = spark.read.csv(files, schema=", ".join(f"c{k} string" for k in range(len(names))), header=True, mode="PERMISSIVE")
        places = _places([f.name for f in fields], names, kind)
        typed = [(F.lit(None) if k is None else F.col(f"c{k}")).try_cast(f.dataType).alias(f.name) for f, k in zip(fields, places, strict=True)]
        rows = rows.unionByName(text.select(*run_of(F.col("_metadata.file_path")), *typed))
    return rows if runs is None else rows.join(F.broadcast(runs.select("run_dir")), "run_dir", "left_semi")  # one short row a run


def read_stats_zip(spark: SparkSession, roots: Sequence[str], kind: str, schema: str | None = None) -> DataFrame:
    """The same from member kind.csv of each run's stats.zip. An archive is a task's unit of work and may have up to 2 GB."""
    fields = StructType.fromDDL(schema or stats_schema(kind)).fields
    columns = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if f"{kind}.csv" not in archive.namelist():
                        continue
                    with archive.open(f"{kind}.csv") as member:
                        lines = csv.reader(io.TextIOWrapper(member, "utf-8", newline=""))
                        header = next(lines, None)
                        if not header:
                            continue
                        places = _places(columns, header, kind)
                        while some := list(islice(lines, 10_000)):
                            cells = [[(x[k] or None) if k is not None and k < len(x) else None for k in places] for x in some if x]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(cells), pa.string()), pa.array(cells, pa.list_(pa.string()))], ["path", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "stats.zip").load(list(roots)).select("path", "content")
    rows = files.mapInArrow(run, "path string, cells array<string>")
    return rows.select(*run_of(F.col("path")), *[F.col("cells")[k].try_cast(f.dataType).alias(f.name) for k, f in enumerate(fields)])


def write_stats(df: DataFrame, path: str, fmt: str = "parquet", digits: int = 4) -> None:
    """Appends statistics by experiment and run, doubles rounded half to even."""
    out = df.select(*[F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("append").partitionBy("experiment", "run").format(fmt).save(path)
