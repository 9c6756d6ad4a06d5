"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times and a sample of them once more,
with inclusion probability r - floor(r). The sample is balanced on words and on documents: within blocks of bounded
size, probabilities move along the null space of both totals until at most two of a block are undecided; those meet
in fewer blocks, level by level, until at most two of a source are left, which land where the total is nearest. A source
lands in the level in which it has one block. Some decided documents of each block go along, so that they can still change sides there.
Blocks, order and draws follow from document ids and texts alone, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm.common import free_name, n_words, row_id, stage

#: Weights of sources in their order, share of all words that the mix has, most times that a source is read.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK, FLIPS = 4096, 64
#: Decided documents of a block that go on to the next level.
CARRIED = 256
_EDGE = 1e-9


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words that each source shall give: shares by weight; what passes `most` times a source's size is shared anew."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[k % len(weights)] for k, x in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[x] for x in open_)
        over = [x for x in open_ if unit * weight[x] > most * sizes[x]]
        if not over:
            return out | {x: unit * weight[x] for x in open_}
        for x in over:
            out[x] = most * sizes[x]
            left -= out[x]
        open_ = [x for x in open_ if x not in over]
    return out


def _fly(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> None:
    """Moves the probabilities in place until at most two are strictly between 0 and 1; keeps sum(p) and sum(p * size)."""
    hand: list[int] = []
    for k in range(len(p)):
        if not _EDGE < p[k] < 1 - _EDGE:
            p[k] = round(p[k])
            continue
        hand.append(k)
        while len(hand) == 3:
            a, b, c = hand
            x, y, z = p[a], p[b], p[c]
            u, v, w = size[b] - size[c], size[c] - size[a], size[a] - size[b]
            if u == 0 and v == 0:
                u, v, w = 1.0, -1.0, 0.0
            forth = min((1 - q) / d if d > 0 else q / -d for q, d in ((x, u), (y, v), (z, w)) if d)
            back = min(q / d if d > 0 else (1 - q) / -d for q, d in ((x, u), (y, v), (z, w)) if d)
            step = forth if draw.random() * (forth + back) < back else -back
            p[a], p[b], p[c] = x + step * u, y + step * v, z + step * w
            kept = [i for i in hand if _EDGE < p[i] < 1 - _EDGE]
            for i in hand:
                if i not in kept:
                    p[i] = round(p[i])
            hand = kept


def _land(p: np.ndarray, size: np.ndarray, want: float) -> None:
    """The two that are left go where the total of words comes nearest; at most FLIPS others of the block change sides to bring it nearer.

    One very long document can stay undecided to the end, as moving it takes many short ones; its rounding alone would miss by up to half its size.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    rest = want - float(p[(p == 1)] @ size[p == 1])
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(left) if m >> k & 1) - rest), m))
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    for _ in range(FLIPS):
        over = float(p @ size) - want
        change = np.abs(over + np.where(p == 1, -size, size))
        k = int(change.argmin())
        if change[k] >= abs(over):
            return
        p[k] = 1 - p[k]


def _going(p: np.ndarray, n: int) -> np.ndarray:
    """The undecided, and at most n decided of either kind. Rows are sorted by size: the largest, to make up for a long document, and others spread evenly down to the last."""
    go = (p > 0) & (p < 1)
    for side in (0, 1):
        some = np.flatnonzero(p == side)
        many = min(n, len(some))
        spread = len(some) - 1 - np.linspace(0, len(some) - 1, many - many // 2).astype(int)
        go[some[: many // 2]] = True
        go[some[spread]] = True
    return go


def _numbered(units: DataFrame) -> DataFrame:
    """units with a key of its own for each row of a source that repeats an id and text, so that such rows spread over all blocks.

    Rows are numbered within a key and a part of the scan, after those of the parts before, of which only counts are
    sorted. Rows of one key are equal, so it doesn't matter which has which number.
    """
    same = units.withColumn("same", F.xxhash64(F.col("source").isNull(), "source", "key"))
    counts = same.groupBy("same", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("same").orderBy("part")) - F.col("n")).where("before > 0").drop("n")
    numbered = same.withColumn("nth", F.row_number().over(Window.partitionBy("same", "part").orderBy("row")) - 1).join(before, ["same", "part"], "left")
    nth = F.col("nth") + F.coalesce("before", F.lit(0))
    return numbered.withColumn("key", F.when(nth > 0, F.xxhash64("key", nth)).otherwise(F.col("key"))).select(units.columns)


def _block(seed: int, level: int, carried: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "row"], ascending=[False, True, True])  # what is left at the end is small
        p, size = rows["p"].to_numpy(float, copy=True), rows["size"].to_numpy(float)
        name = f"{seed}/{level}/{rows['rank'].iloc[0]}/{rows['block'].iloc[0]}"
        want = float(p @ size)
        _fly(p, size, np.random.default_rng(zlib.crc32(name.encode())))
        if rows["blocks"].iloc[0] > 1:
            return rows.assign(p=p, go=_going(p, carried // 2))
        _land(p, size, want)
        return rows.assign(p=p, go=False)

    return run


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source", row: str | None = None) -> DataFrame:
    """Columns row, doc_id, source, size, source_size, target, copies: one row for each row of docs.

    A null source is a source, the last. Null and empty texts have size 0. Repeated rows are documents of their own.
    An empty table gives no rows; a mix of nothing but empty texts takes nothing.
    `row` names a column that numbers the rows, if there is one. The driver sees one total for each source, of which there are taken to be thousands at most.
    """
    spark = docs.sparkSession
    t, i, s = F.col(text), F.col(doc_id).cast("long"), F.col(source).cast("string")
    units = stage(docs.select((F.col(row) if row else row_id()).alias("row"), i.alias("doc_id"), s.alias("source"), n_words(t).alias("size"), F.xxhash64(i, t).alias("key"), F.spark_partition_id().alias("part")), "units")
    sizes = {r.source: (r.size, r.n) for r in units.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    goal = targets({k: v[0] for k, v in sizes.items()}, weights, share, most)
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    plan = []
    for rank, name in enumerate(names):
        size, n = sizes[name]
        times = goal[name] / size if size else 0.0
        sure = int(times + _EDGE)
        plan.append((rank, name, int(size), float(goal[name]), sure, max(0.0, times - sure), -(-n // BLOCK)))
    table = spark.createDataFrame(plan, "rank int, source string, source_size long, target double, sure int, p double, blocks long")
    todo = _numbered(units)
    todo = todo.join(F.broadcast(table), todo["source"].eqNullSafe(table["source"])).select(todo["*"], "rank", "p", "blocks")
    done, level = None, 0
    most_blocks = max([1, *(x[-1] for x in plan)])
    carried = min(CARRIED, BLOCK // 2 - 2)  # blocks must become fewer
    while True:
        blocks = todo.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks"))).select("row", "size", "key", "rank", "p", "blocks", "block")
        moved = stage(blocks.groupBy("rank", "block").applyInPandas(_block(seed, level, carried), blocks.withColumn("go", F.lit(True)).schema), f"cube-{level}")
        settled = moved.where("not go").select("row", F.col("p").cast("int").alias("taken"))
        done = settled if done is None else done.unionByName(settled)
        if most_blocks == 1:
            break
        todo = moved.where("go").drop("go").withColumn("blocks", F.ceil(F.col("blocks") * (2 + carried) / BLOCK))
        most_blocks, level = -(-most_blocks * (2 + carried) // BLOCK), level + 1
    facts = F.broadcast(table.drop("p", "blocks", "rank"))
    out = units.join(facts, units["source"].eqNullSafe(facts["source"])).select(units["*"], "source_size", "target", "sure")
    return out.join(done, "row").select("row", "doc_id", "source", "size", "source_size", "target", (F.col("sure") + F.col("taken")).alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all columns of docs, whatever their names. Otherwise like mix()."""
    row, times = free_name(docs, "row"), free_name(docs, "copies")
    staged = stage(docs.withColumn(row, row_id()), "mix-input")
    copies = mix(staged, row=row, **how).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    often = F.explode(F.sequence(F.lit(1), F.col(times))).alias(free_name(docs, "copy"))
    return staged.join(copies, row).select(*docs.columns, often).select(*docs.columns)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
