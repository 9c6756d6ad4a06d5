"""Hard negatives and centroid clustering on vectors with every odd case, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.llm import centroids, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, heap long, score long, part int, cluster int, v string"


def vectors(dim=64, n=260):
    draw = random.Random(5)
    vector = lambda: [draw.gauss(0, 0.12) for _ in range(dim)]
    hot = vector()
    rows = [(k, hot if k % 3 == 0 else vector(), draw.randrange(4)) for k in range(n)]  # a third of all rows are equal: ties
    rows += [(1000, None, 1), (1001, [None] * dim, 1), (1002, [0.1] * (dim - 1) + [float("nan")], 1), (1003, [float("inf")] + [0.1] * (dim - 1), 1), (1004, vector(), None), (None, vector(), 2)]
    rows += [(1005, [], 0), (1006, vector()[:-1], 0), (1007, [*vector(), 0.5], 0), (1008, [0.0] * dim, 0), (1009, [-1.0] * dim, 3)]
    rows += [(1100, [1e30, -1e30] + [0.1] * (dim - 2), 2), (1101, [1e30, -1e30] + [0.1] * (dim - 2), 1), (1102, [3e6] * dim, 2)]
    rows += [(5, rows[5][1], rows[5][2])] * 2 + [(100, vector(), 1)]  # repeated rows; an id with two vectors
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "v") for r in vectors()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole(scale, v):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize(("m", "k", "n"), [(1, 1, 1), (64, 64, 64), (33, 64, 65), (70, 19, 41), (128, 63, 100), (0, 5, 3), (4, 0, 7)])
def test_strassen(m, k, n):
    draw = np.random.default_rng(m + k + n)
    a, b = draw.integers(-(1 << 20), 1 << 20, (m, k)), draw.integers(-(1 << 20), 1 << 20, (k, n))
    assert (negatives.strassen(a, b, 4) == a @ b).all()
    assert (negatives.strassen(a.astype(object), b.astype(object), 4) == a @ b).all()


def test_products_of_any_size():
    a, b = np.array([[2.0**40, 3.0], [2.0**70, 1.0]]), np.array([[2.0**20, 5.0, 1.0], [2.0**30, 0.0, 0.0]])
    most = (1 << 63) - 2
    assert negatives.products(a, b).tolist() == [[(1 << 60) + 15, most], [most, most]]
    assert negatives.products(-a, b)[1].tolist() == [-most, -most]


def test_heaps_merge():
    draw = np.random.default_rng(1)
    score, ids = draw.integers(0, 9, (7, 300)), draw.integers(0, 50, 300)
    heaps = negatives.Heaps(7, 5)
    for k in range(0, 300, 37):
        heaps.offer(slice(0, 7), score[:, k : k + 37], ids[k : k + 37], np.ones((7, 1), bool))
    for a in range(7):
        want = sorted(zip(score[a].tolist(), ids.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:5]
        assert list(zip(heaps.score[a].tolist(), heaps.id[a].tolist(), strict=True)) == want


def brute_negatives(rows, every, low=80, high=100, k=5):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, whole(256, v)) for i, v, label in rows if i is not None and label is not None and finite(v)]
    most, out = (1 << 63) - 2, []
    dot = lambda a, b: max(-most, min(most, sum(x * y for x, y in zip(a, b, strict=False))))
    for i, label, v in rows:
        if i % every:
            continue
        positives = sorted((-dot(v, w), j) for j, other, w in rows if other == label and j != i)[:k]
        all_negatives = sorted((-dot(v, w), j) for j, other, w in rows if other != label)
        for p, j in positives:
            fit = [(s, x) for s, x in all_negatives if low * -p <= 100 * -s <= high * -p][:k]
            out += [(i, j, rank, x, -p, -s) for rank, (s, x) in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 5000])
def test_negatives(table, empty, monkeypatch, part_bytes):
    """With parts of a few anchors, results are the same."""
    monkeypatch.setattr(negatives, "PART_BYTES", part_bytes)
    rows = negatives.taking_part(table).withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    found = negatives.mine(rows, F.col("vec_id") % 20 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(vectors(), 20)
    assert len(want) > 100
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert negatives.mine(negatives.taking_part(empty), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.mine(rows, F.col("vec_id") < 0).count() == 0


def test_negatives_of_given_windows(table):
    """Wider windows, fewer partners, another scale: by label alone."""
    rows = negatives.taking_part(table.where("vec_id < 100"))
    found = negatives.mine(rows, F.col("vec_id").isin(3, 8), positives=2, negatives=3, low=10, high=300)
    assert found.groupBy("anchor_id", "positive_id").agg(F.max("rank").alias("n")).where("n > 3").count() == 0
    bad = found.where("10 * positive_score > 100 * negative_score or 100 * negative_score > 300 * positive_score")
    assert found.count() and not bad.count()


def brute_centroids(rows, dim, clusters, rounds, seed=3):
    held = 1 << 60
    rows = [(i, [max(-held, min(held, x)) for x in whole(1024, v)]) for i, v, _ in rows if finite(v) and len(v) == dim]
    order = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(rows, key=order)[:clusters]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in rows:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in rows]
    own, most = Counter(), (1 << 63) - 1
    for _, d, k in found:
        own[k] += min(d, most)
    total = sum(own.values())
    return [(i, k, min(d, most), min(own[k], most), min(total, most)) for i, d, k in found], centres


@pytest.mark.parametrize("n", [260, 5])
def test_centroids(spark, table, empty, n):
    rows = [r for r in vectors() if n == 260 or r[0] is not None and r[0] < n]
    data = table if n == 260 else table.where(f"vec_id < {n}")
    if n == 5:
        rows = [r for r in vectors() if r[0] is not None and r[0] < n]
    found, centres = centroids.cluster(centroids.integers(data), rounds=4)
    want, want_centres = brute_centroids(rows, 64, 8, 4)
    assert [list(map(int, c)) for c in centres] == want_centres
    out = centroids.with_inertia(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia")
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_centroids_of_nothing(empty, table):
    for data in (empty, table.where("vec_id = 1000"), table.where("vec_id = 1006")):
        found, centres = centroids.cluster(centroids.integers(data))
        assert len(centres) == 0 and centroids.with_inertia(found).count() == 0


def test_sums_are_exact_floors():
    block = next(centroids._encoded(iter([_batch([[-3, 5], [-4, 5], [2, -1]])])))
    b = centroids.Block(3, *(block.column(k)[0].as_py() for k in (1, 2, 3)))
    nearest, distance = b.assign(np.array([[0, 0], [-4, 5]]))
    assert nearest.tolist() == [1, 1, 0] and distance.tolist() == [1, 0, 5]
    assert b.sums(nearest, 2) == [[2, -1], [-7, 10]]


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["vec_id", "v"])
