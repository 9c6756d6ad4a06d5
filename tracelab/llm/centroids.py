"""Centroid clustering with scalar lookup tables.

Vectors of whole numbers are stored once as blocks: of each dimension the occurring values, and a code into them for each
row. In a round, a block tabulates the squared difference of each occurring value and each centroid by dimension;
distances are gathers from these tables, summed over dimensions. Blocks give sums and counts by cluster, which Spark
adds up; the driver sees one row for each cluster and dimension. Everything is exact, so that reruns agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracelab.llm.common import free_name, stage

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, 3
#: Rows of a block: codes fit 16 bits.
BLOCK = 4096
#: Whole numbers are held within this.
MOST = 1 << 60
#: Values within this have distances that 64 bits hold in up to 2**12 dimensions.
_SMALL = 1 << 24
_LONG = (1 << 63) - 1


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of vectors with exactly `dimensions` components, none null, NaN or infinite; components are floor(scale * x) as doubles, held within 2**60."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * scale)))
    return vectors.where((F.size(v) == dimensions) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(whole, lambda x: F.floor(x)).alias("v"))


def starts(rows: DataFrame, clusters: int, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest SHA-256 of `seed:vec_id`, in that order, fewer if there are fewer. Null ids come last; rows of one id by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("h"), "v").orderBy(F.col("h").isNull(), "h", "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: ids, codes (dimensions x rows), occurring values of all dimensions one after the other, where each dimension's begin."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).T
            found = [np.unique(x, return_inverse=True) for x in v]
            codes = np.array([c for _, c in found], np.uint16).reshape(len(v), -1)
            values = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
            begin = np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (codes, values, begin))], ["ids", "codes", "first", "begin"])


class Block:
    """A block read back."""

    def __init__(self, n: int, codes: bytes, values: bytes, begin: bytes):
        begin, values = np.frombuffer(begin, np.int32), np.frombuffer(values, np.int64)
        self.codes, self.values = np.frombuffer(codes, np.uint16).reshape(len(begin) - 1, n), [values[a:b] for a, b in zip(begin, begin[1:])]

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest centroid, the first of equally near ones, and the squared distance."""
        small = max(np.abs(x).max(initial=0) for x in [centroids, *self.values]) < _SMALL
        distance = np.zeros((self.codes.shape[1], len(centroids)), np.int64 if small else object)
        for values, code, centre in zip(self.values, self.codes, centroids.T, strict=True):
            table = (values.astype(distance.dtype)[:, None] - centre.astype(distance.dtype)) ** 2
            distance += table[code]
        nearest = distance.argmin(1)
        return nearest, distance[np.arange(len(nearest)), nearest]

    def sums(self, nearest: np.ndarray, clusters: int) -> list[list[int]]:
        """Of each cluster and dimension the sum of its rows: how often each value occurs there, times the value."""
        out = [[0] * len(self.values) for _ in range(clusters)]
        for d, (values, code) in enumerate(zip(self.values, self.codes, strict=True)):
            count = np.bincount(nearest * len(values) + code, minlength=clusters * len(values)).reshape(clusters, -1)
            kind = np.int64 if np.abs(values).max(initial=0) < _SMALL else object
            for c, total in enumerate((count.astype(kind) * values.astype(kind)).sum(1)):
                out[c][d] = int(total)
        return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, Block]]:
    for ids, *parts in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
        yield ids.values, Block(len(ids.values), *parts)


def _summed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, block in _blocks(batch):
                nearest, _ = block.assign(centroids)
                sums += np.array(block.sums(nearest, len(centroids)), object)
                counts += np.bincount(nearest, minlength=len(centroids))
        c, d = (x.ravel() for x in np.indices(centroids.shape))
        total = pa.array([Decimal(int(x)) for x in sums.ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), total, pa.array(counts[c])], ["cluster", "dim", "total", "n"])

    return run


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _blocks(batch):
                nearest, distance = block.assign(shared.value)
                held = distance if distance.dtype == np.int64 else np.array([min(int(x), _LONG) for x in distance], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(held)], ["vec_id", "cluster", "distance"])

    return run


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for each row of (vec_id, v), and the centroids.

    v holds whole numbers of one length. Centroids start as starts() has them. Each round assigns rows to the nearest (ties:
    the first) and moves each centroid that has rows to floor(sum / count) of them. Then rows are assigned once more. Repeated
    rows and null ids count each. Distances over 2**63 - 1 are held at it. Without rows, there are neither rows nor centroids.
    """
    spark = rows.sparkSession
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    blocks = stage(rows.mapInArrow(_encoded, "ids array<long>, codes binary, first binary, begin binary"), "blocks")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        sums = blocks.mapInArrow(_summed(shared), "cluster int, dim int, total decimal(38,0), n long")
        centroids = centroids.copy()
        for r in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            if r.n:
                centroids[r.cluster, r.dim] = int(r.total) // r.n
        shared.unpersist()
    return blocks.mapInArrow(_assigned(spark.sparkContext.broadcast(centroids)), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """assigned with two more columns: the distances summed over the row's cluster and over all; sums over 2**63 - 1 are held at it."""
    rows = stage(assigned, "clusters")
    held = lambda c: F.least(c, F.lit(Decimal(_LONG))).cast(LongType())
    own, name = F.sum(F.col(distance).cast("decimal(38,0)")), free_name(rows, "c")
    sums = rows.groupBy(F.col(cluster).alias(name)).agg(own.alias("s"))  # a row for each cluster
    total = sums.agg(F.sum("s").alias("t")).first().t
    sums = sums.select(name, held(F.col("s")).alias("cluster_inertia"), held(F.lit(total).cast("decimal(38,0)")).alias("inertia"))
    return rows.join(F.broadcast(sums), rows[cluster] == sums[name]).drop(name)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found, centroids = cluster(rows)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return with_inertia(found).withColumn("centroid_sha256", F.element_at(F.lit(digests or [""]), F.col("cluster") + 1))


def _sql() -> str:
    """Rounds are spelled out: each is a table of centroids that follows from the one before."""
    near = "select id, arg_min(k, (d, k)) as k, min(d) as d from (select id, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{i} c using (dim) group by id, c.k) group by id"
    moved = "select c.k, c.dim, coalesce(s.x, c.x) as x from c{i} c left join (select k, dim, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) as x from a{i} join v using (id) group by k, dim) s using (k, dim)"
    rounds = "".join(f",\na{i} as materialized ({near.format(i=i)}),\nc{i + 1} as materialized ({moved.format(i=i)})" for i in range(ROUNDS))
    return f"""
with e as materialized (select row_number() over () as id, vec_id, [floor({SCALE} * x::double)::bigint for x in embedding] as q from embeddings where len(embedding) = {DIMENSIONS} and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
v as materialized (select id, unnest(q)::hugeint as x, generate_subscripts(q, 1) as dim from e),
c0 as materialized (select k, v.dim, v.x from (select id, row_number() over (order by sha256('{SEED}:' || vec_id), q) - 1 as k from e) s join v using (id) where k < {CLUSTERS}){rounds},
z as materialized ({near.format(i=ROUNDS)}),
h as (select k, sha256(string_agg(x::varchar, ',' order by dim)) as digest from c{ROUNDS} group by k)
select vec_id, z.k::int as cluster, z.d::bigint as distance, (sum(z.d) over (partition by z.k))::bigint as cluster_inertia, (sum(z.d) over ())::bigint as inertia, digest as centroid_sha256
from z join e using (id) join h on h.k = z.k
"""


SQL = _sql()
