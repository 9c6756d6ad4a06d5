"""Hard negatives: rows of another label that are nearly as near to an anchor as its positives.

Anchors are a stated query set, dealt into parts of bounded size; each part is broadcast and meets all rows, as Spark
reads them, in tiles. A tile's inner products come from Strassen's multiplication on integers. Heaps of the best rows,
one for each anchor and one for each window of scores under a positive, are held by task and merged by a ranking that
sees a few rows from each task. Positives multiply the tiles of one label only; windows need them first, so
that a second pass multiplies all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm.common import stage

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score in percent of the positive's: at least, at most.
LOW, HIGH = 80, 100
#: Rows of a tile, anchors of a tile; the side from which on a product is taken directly; bytes of anchors that go to all tasks at once.
TILE, ANCHORS, LEAF, PART_BYTES = 1024, 256, 16, 32 << 20
#: Scores outside of this are held at it.
_MOST = (1 << 63) - 2
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a times b by seven products of halves. Odd sides get a row or column of zeros. Sums of integers wrap around in steps and are exact if the result fits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    (a11, a12), (a21, a22) = (np.hsplit(x, 2) for x in np.vsplit(a, 2))
    (b11, b12), (b21, b22) = (np.hsplit(x, 2) for x in np.vsplit(b, 2))
    p, q = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    r, s = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    t, u, v = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), a.dtype)
    out[: m // 2, : n // 2], out[: m // 2, n // 2 :], out[m // 2 :, : n // 2], out[m // 2 :, n // 2 :] = p + s - t + v, r + t, q + s, p - q + r + u
    return out


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, which hold whole numbers as doubles; the shorter ones end in zeros. 64-bit arithmetic where results fit, else numbers of any size."""
    dim = max(a.shape[1], b.shape[1])
    a, b = _wide(a, dim), _wide(b, dim).T
    largest = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if max(*largest, dim * largest[0] * largest[1]) < 1 << 62:
        return strassen(a.astype(np.int64), np.ascontiguousarray(b.astype(np.int64)))
    a, b = (np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (a, b))
    return np.clip(strassen(a, b), -_MOST, _MOST).astype(np.int64)


def matrix(lists: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of lists of doubles, one a row, filled with zeros."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * scale)


class Heaps:
    """The k best of each of n heaps: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, at: slice, score: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Rows `ids` with their scores, a row for each of the heaps `at`, where they fit."""
        held, names = self.score[at], self.id[at]
        worst, k = held[:, -1:], held.shape[1]
        row, col = np.nonzero(fit & ((score > worst) | ((score == worst) & (ids < names[:, -1:]))))
        if not len(row):
            return
        rows = np.concatenate([row, np.repeat(np.arange(len(held)), k)])
        scores, ids = np.concatenate([score[row, col], held.ravel()]), np.concatenate([ids[col], names.ravel()])
        order = np.lexsort((ids, ~scores, rows))
        best = order[np.searchsorted(rows[order], np.arange(len(held)))[:, None] + np.arange(k)]
        self.score[at], self.id[at] = scores[best], ids[best]

    def batches(self, n: int = 1 << 15) -> Iterator[pa.RecordBatch]:
        heap, place = np.nonzero(self.score != _NONE)
        for k in range(0, len(heap), n):
            h, p = heap[k : k + n], place[k : k + n]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(self.score[h, p]), pa.array(self.id[h, p])], ["heap", "score", "id"])


_HEAP = "heap long, score long, id long"


def _slices(lo: int, hi: int, step: int) -> list[slice]:
    return [slice(k, min(k + step, hi)) for k in range(lo, hi, step)]


def _best_positives(part, scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_label, v = part.value
        heaps = Heaps(len(own), k)
        for batch in batches:
            ids, label, w = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), scale)
            order = np.argsort(label, kind="stable")
            for x in np.intersect1d(label, own_label):
                first, last = np.searchsorted(own_label, x), np.searchsorted(own_label, x, "right")
                rows = order[np.searchsorted(label, x, sorter=order) : np.searchsorted(label, x, "right", sorter=order)]
                for b in _slices(0, len(rows), TILE):
                    r = rows[b]
                    for a in _slices(first, last, ANCHORS):
                        heaps.offer(a, products(v[a], w[r]), ids[r], own[a, None] != ids[r])
        yield from heaps.batches()

    return run


def _best_negatives(part, scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_label, v, low, high = part.value
        n, slots = low.shape
        heaps = [Heaps(n, k) for _ in range(slots)]
        for batch in batches:
            ids, label, w = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), scale)
            for b in _slices(0, len(ids), TILE):
                for a in _slices(0, n, ANCHORS):
                    score, other = products(v[a], w[b]), own_label[a, None] != label[b]
                    for j in range(slots):
                        heaps[j].offer(a, score, ids[b], other & (score >= low[a, j, None]) & (score <= high[a, j, None]))
        for j in range(slots):
            for batch in heaps[j].batches():
                yield batch.set_column(0, "heap", pa.array(batch.column(0).to_numpy() * slots + j))

    return run


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each heap, of what tasks give."""
    best = Window.partitionBy("heap").orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def taking_part(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of rows without a null among id, label, vector and components, and without NaN or infinity."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows are (vec_id, label, v), as taking_part() gives them.

    Components become floor(scale * x); a score is an inner product, exact at any size, held at 2**63 - 2 where no long can
    have it. Shorter vectors end in zeros. An anchor's positives are the best `positives` rows of its label and of another id;
    for each, the best `negatives` rows of other labels with low * positive <= 100 * score <= high * positive are returned.
    Rows repeated under one id count each, as anchors too. Ties go to the smaller id. Without rows, anchors or rows in a
    window, there are none.
    """
    spark = rows.sparkSession
    chosen = rows.where(anchor)
    n, dim = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = max(1, -(-n * max(dim, 1) * 8 // PART_BYTES))
    dealt = stage(chosen.repartition(parts).withColumn("part", F.spark_partition_id()), "anchors")
    out = None
    for k in range(parts):
        found = stage(_mine_part(spark, rows, dealt.where(F.col("part") == k).drop("part"), positives, negatives, low, high, scale), f"negatives-{k}")
        out = found if out is None else out.unionByName(found)
    return out


def _mine_part(spark: SparkSession, rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """Of anchors that fill PART_BYTES at most, about: they and their positives pass through the driver."""
    table = anchors.toArrow().sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
    own, own_label = table["vec_id"].to_numpy(), table["label"].to_numpy()
    v = matrix(table["v"].combine_chunks(), scale)
    near = rows.mapInArrow(_best_positives(spark.sparkContext.broadcast((own, own_label, v)), scale, positives), _HEAP)
    best = _merged(near, positives).toArrow()
    heap, slot = best["heap"].to_numpy(), best["rank"].to_numpy() - 1
    score, names = np.zeros((len(own), positives), np.int64), np.zeros((len(own), positives), np.int64)
    score[heap, slot], names[heap, slot] = best["score"].to_numpy(), best["id"].to_numpy()
    least, most = np.ones_like(score), np.zeros_like(score)  # nothing fits
    least[heap, slot] = [-(-low * int(x) // 100) for x in score[heap, slot]]
    most[heap, slot] = [high * int(x) // 100 for x in score[heap, slot]]
    windows = pa.table({"heap": heap * positives + slot, "anchor_id": own[heap], "positive_id": names[heap, slot], "positive_score": score[heap, slot]})
    windows = spark.createDataFrame(windows)
    hard = rows.mapInArrow(_best_negatives(spark.sparkContext.broadcast((own_label, v, least, most)), scale, negatives), _HEAP)
    found = _merged(hard, negatives).join(F.broadcast(windows), "heap")  # at most `positives` rows an anchor of this part
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taking_part(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, [floor(256 * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by positive_score desc, positive_id) as k from
  (select a.vec_id as anchor_id, b.vec_id as positive_id, list_dot_product(a.v, b.v)::bigint as positive_score from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0)) where k <= 5),
n as (select a.vec_id as anchor_id, b.vec_id as negative_id, list_dot_product(a.v, b.v)::bigint as negative_score from e a join e b on a.label <> b.label where a.vec_id % 100 = 0)
select * from (select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as int) as rank, negative_id, positive_score, negative_score
  from p join n using (anchor_id) where 80 * positive_score <= 100 * negative_score and 100 * negative_score <= 100 * positive_score) where rank <= 5
"""
