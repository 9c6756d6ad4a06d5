"""Reading raw trace files and reading and writing cleaned ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab import schemas


def input_order() -> Column:
    """Sorts like the input: by file, place in it and row. Only right directly on the scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _read(spark: SparkSession, path: str, schema: str, strict: bool, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a headerless CSV file. Fields are read as text, trimmed and cast; empty is null."""
    fields = T._parse_datatype_string(schema).fields if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], schema).schema.fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField("_corrupt", T.StringType())])
    raw = spark.read.csv(path, schema=text, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.select("*", input_order().alias("ord"))
    given = {f.name: F.nullif(F.trim(F.col(f.name)), F.lit("")) for f in fields}
    cast = {n: given[n].try_cast(f.dataType) for n, f in zip(given, fields, strict=True)}
    wrong = F.when(F.col("_corrupt").isNotNull(), "columns")
    for f in fields:
        wrong = wrong.when(given[f.name].isNotNull() & cast[f.name].isNull(), f.name)
        if f.name in needed:
            wrong = wrong.when(given[f.name].isNull(), f.name)
    judged = raw.withColumn("reason", wrong)
    good = judged.where("reason is null").select(*[cast[f.name].alias(f.name) for f in fields], "ord")
    rejects = judged.where("reason is not null").select(F.coalesce("_corrupt", F.concat_ws(",", *[f.name for f in fields])).alias("line"), "reason")
    if strict and (n := rejects.count()):
        raise ValueError(f"{n} rows can't be read")
    return good, rejects


def read_machine_meta(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    return _read(spark, path, schemas.RAW_MACHINE_META, strict, ("machine_id", "time_stamp", "cpu_num", "mem_size", "status"))


def read_container_meta(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    return _read(spark, path, schemas.RAW_CONTAINER_META, strict, ("container_id", "machine_id", "time_stamp", "app_du", "status", "cpu_request", "mem_size"))


def read_batch_task(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    good, rejects = _read(spark, path, schemas.RAW_BATCH_TASK, strict, ("task_name", "job_name", "start_time", "end_time"))
    late = good.where("start_time < 0 or end_time < 0").select(F.concat_ws(",", "task_name", "job_name").alias("line"), F.lit("time").alias("reason"))
    return good.where("start_time >= 0 and end_time >= 0"), rejects.unionByName(late)


def read_clean_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned jobs file; its header must name the columns in order. connections becomes an array, empty without any."""
    rows = spark.read.csv(path, header=True, schema=schemas.CLEAN_JOBS, enforceSchema=False)
    return rows.withColumn("connections", F.filter(F.split(F.coalesce("connections", F.lit("")), "_"), lambda x: x != ""))


def write_ordered(df: DataFrame, path: str, keys: list[str], fmt: str = "csv") -> None:
    """Part files in global order of the keys, with a header where the format has one."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out.write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).mode("errorifexists").save(path)


def write_clean_jobs(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_ordered(df, path, ["submit", "job", "task_group"], fmt)


def write_clean_machines(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_ordered(df, path, ["machine", "time"], fmt)
