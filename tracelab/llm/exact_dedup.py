"""Exact deduplication against a persistent digest index (built-in functions only).

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row a digest,
anti-joined with the index by sort-merge, and what is new is appended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import SPACE, attach, free_name, row_id, scratch, shuffle_partitions, stage


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


@dataclass(frozen=True)
class DigestIndex:
    """An index in `path`, known to this session as table `table`."""

    spark: SparkSession
    table: str
    path: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
        """Opens the index at a path, or makes an empty one. `buckets` must stay as it was when it was made."""
        table = "digest_index_" + path.rstrip("/").rpartition("/")[2].replace("-", "_")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, first_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets or shuffle_partitions(spark)} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, table, path)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("digest", "first_id", "batch").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """The session forgets the index; its files stay, and open() finds them again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def ingest(docs: DataFrame, index: DigestIndex, batch: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Takes a batch into the index; returns a decision for every row.

    Columns: row, doc_id, digest, keep_id (id of the document that stays, of this batch or one before),
    group_size (rows of this batch with that text), kept (this row stays). The smallest doc_id of a text
    stays, null ids last; of rows repeated under one id just one stays. Null text is empty text. An empty
    table gives no rows and leaves the index as it is. A batch that is taken again, after a crash, gets
    the same decisions.
    """
    rows = stage(docs.select(row_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest")), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = stage(rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")), "digest-groups")
    fresh = groups.join(index.read().hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("first.doc_id").alias("first_id"), F.lit(batch).alias("batch")))
    held = groups.join(index.read().hint("merge"), "digest").select(
        "digest", "group_size", F.col("first_id").alias("keep_id"), F.when(F.col("batch") == batch, F.col("first.row")).alias("keep_row")
    )
    out = attach(rows, stage(held, "held"), "digest", "group_size", rows.count())
    return out.select("row", "doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns, by a new index. docs is staged so that rows keep their ids."""
    spark = docs.sparkSession
    row = free_name(docs, "row")
    staged = stage(docs.withColumn(row, row_id()), "exact-input")
    rows = staged.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    index = DigestIndex.open(spark, scratch(spark, "index"))
    groups = rows.groupBy("digest").agg(first.alias("first"))
    fresh = stage(groups.join(index.read().hint("merge"), "digest", "left_anti"), "fresh")
    index.append(fresh.select("digest", F.col("first.doc_id").alias("first_id"), F.lit("0").alias("batch")))
    index.close()
    return staged.join(fresh.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex.open(spark, scratch(spark, "index"))
    out = ingest(docs, index, "0")
    index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""
