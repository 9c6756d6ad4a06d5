"""What the operators of this subpackage share: staged tables, row ids, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space in every contract here; a word is a run of anything else.
SPACE = "[ \\x09-\\x0D]+"
WORD = "[^ \\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A session on one machine that names none has a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _local_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


_cached: dict[str, dict] = {}


def cache(operator: str) -> dict:
    """What a Python worker keeps for an operator between batches and tasks. Only the last operator's is held: workers are used again by later stages."""
    if operator not in _cached:
        _cached.clear()
        _cached[operator] = {}
    return _cached[operator]


_tracked: list[str] | None = None


@contextmanager
def tracked() -> Iterator[list[str]]:
    """Lists the scratch paths that are made inside, for remove()."""
    global _tracked
    before, _tracked = _tracked, []
    try:
        yield _tracked
    finally:
        _tracked = before


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch paths, which nothing may need any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _tracked is not None:
        _tracked.append(path)
    return path


#: Rows that go to Python at once, where the session would send more: whole texts are long, and what passes them on keeps its buffers.
ARROW_ROWS = 1_000


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation and row ids are fixed."""
    spark, size = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch(spark, name), spark.conf.get(size)
    spark.conf.set(size, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(size, before)
    return spark.read.schema(df.schema).parquet(path)


def row_id() -> Column:
    """Names a row of a scan; only stable once staged."""
    return F.monotonically_increasing_id()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that starts so and that no column has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words, counted where one begins, without making an array of them. Null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few bytes each that are broadcast at most, after they were counted.
SHORT = 1_000_000


def short(rows: DataFrame) -> DataFrame:
    """Staged rows of row ids, to be broadcast if they are counted to be few; else they are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= SHORT else rows


#: A group with over this share of all rows is hot; fewer than 1000 groups can be.
HOT_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left join groups on key, where groups has one row a key and its number of rows in `size`.

    Groups with over 1/1000 of all rows, of which there are fewer than 1000 by counting, are
    broadcast; the others are joined by a shuffle in which no key is hot.
    """
    share = max(1, total // HOT_SHARE)
    cols = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.where(F.col(size) > share).select(key, F.struct(*cols).alias("_hot")))
    tagged = rows.join(hot, key, "left")
    met = tagged.where("_hot is not null").select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in cols])
    rest = tagged.where("_hot is null").drop("_hot").join(groups.where(F.col(size) <= share), key, "left")
    return met.unionByName(rest.select(*rows.columns, *cols))
