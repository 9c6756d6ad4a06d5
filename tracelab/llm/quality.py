"""Quality by importance resampling.

Two generative models of hashed word 1- and 2-grams, of target text (documents labelled good) and of raw text (all),
give each document a log importance weight. Documents are sampled without replacement in proportion to their weights by
Gumbel top-k: the k largest of log weight plus Gumbel noise, with noise from a hash of the id, so that reruns agree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import cache, free_name, stage

#: Buckets of the models, pseudo-counts that pull the target model to the raw one, labelled documents that are read at most.
BUCKETS, PRIOR, SAMPLE = 1 << 13, 1 << 18, 20_000
#: Tokens whose hashes a worker keeps at hand.
KNOWN = 100_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _buckets(text: str) -> np.ndarray:
    """Buckets of the 1- and 2-grams of lower-cased words and runs of punctuation."""
    known = cache("quality")
    if len(known) > KNOWN:
        known.clear()
    ids = np.empty(0, np.uint32)
    if tokens := _TOKEN.findall(text):
        for x in [x for x in set(tokens) if x not in known]:
            known[x] = zlib.crc32(x.lower().encode("utf-8", "replace"))
        ids = np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens))
    pairs = ids[:-1] * np.uint32(2654435761) + ids[1:] * np.uint32(40503) + np.uint32(1)
    return np.concatenate([ids * np.uint32(2246822519), pairs]) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
            found = np.bincount(_buckets(text or ""), minlength=BUCKETS)
            raw += found
            if good:
                target += found
    yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, good: DataFrame, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """log p(target)/p(raw) of each bucket. good: ids of target documents, of which SAMPLE at most are used, by hash."""
    ids = good.select(F.col(doc_id).cast("long").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).withColumn("good", F.lit(True))
    marked = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id", "left").select("text", "good")
    counts = marked.mapInArrow(_counted, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas().sort_values("bucket")
    raw = np.zeros(BUCKETS) + 1.0
    target = np.zeros(BUCKETS)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    raw /= raw.sum()
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR * raw) / (target.sum() + PRIOR) / raw)


def scored(rows: DataFrame, ratios: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = 0, weight: str = "log_weight", key: str = "key") -> DataFrame:
    """rows with two more columns: the log importance weight of each text, 0 for null and empty ones, and a key, the weight with Gumbel noise."""
    table = ratios.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [float(table[_buckets(x)].sum()) if x else 0.0 for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], [*batch.schema.names, weight])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{weight}` double"
    unit = (F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return rows.mapInArrow(run, schema).withColumn(key, F.col(weight) - F.log(-F.log(unit)))


def kth_largest(keys: DataFrame, k: int, column: str = "key", bins: int = 1024) -> float:
    """The k-th largest value, by counts over ever narrower ranges; the driver sees `bins` counts a round."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0  # values over `high`
    for _ in range(12):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        inside = keys.where(F.col(column).between(low, high))
        cell = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width))).cast("int")
        for r in sorted(inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
        if low == high:
            break
    return float(low)


def threshold(rows: DataFrame, share: float, key: str = "key") -> float:
    """The least key that is sampled when the share of all rows, rounded up, with the largest keys is; rows that tie with it are sampled too."""
    return kth_largest(rows, int(np.ceil(rows.count() * share)), key)


#: Part of the rest that is sampled too: noise among short texts near the threshold then lets in some bad ones rather than losing good ones.
ROOM = 0.1


def sampled_share(labels: DataFrame) -> float:
    """The share of documents that is sampled: that of good labels, and ROOM of the rest. 1 without labels."""
    good = float(labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 1.0)
    return good + ROOM * (1 - good)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are sampled, with all their columns. Null and empty texts have weight 0. An empty table gives no rows."""
    ratios = log_ratios(docs, labels.where("quality = 1"))
    weight, key = free_name(docs, "log_weight"), free_name(docs, "key")
    rows = stage(scored(docs, ratios, weight=weight, key=key), "quality")
    return rows.where(F.col(key) >= F.lit(threshold(rows, sampled_share(labels), key))).select(*docs.columns)


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratios = log_ratios(docs, labels.where("quality = 1"))
    rows = stage(scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios).drop("text"), "weights")
    return rows.withColumn("kept", F.col("key") >= F.lit(threshold(rows, sampled_share(labels))))
