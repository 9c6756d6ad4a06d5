"""Packing of token pieces into fixed-length sequences by exact complements.

Documents become pieces in tasks. The plan needs only how many pieces have each length, at most
`length` numbers: combinations of lengths that fill a sequence exactly are consumed under those counts
(one, two or three pieces beside the longest), the rest goes by best fit. Pieces then find their places
by rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import cache, row_id, shuffle_partitions, stage
from tracelab.llm.tokenizer import encode_pieces, load, split, vocabulary_path

LENGTH, END = 2048, 0
#: Pre-tokens whose ids a worker keeps at hand, the first that it meets, and the longest it keeps: at most about 80 MB.
CACHE, CACHE_CHARS = 400_000, 48


def _document_ids(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text, four bytes each."""
    tokenizer, cuts, kept = load(path), [split(x) for x in texts], cache("packing")
    found = [list(map(kept.get, rest)) for _, rest in cuts]
    gaps = [[k for k, y in enumerate(ids) if y is None] for ids in found]
    new = list({rest[k] for (_, rest), some in zip(cuts, gaps, strict=True) for k in some})
    now = dict(zip(new, encode_pieces(path, new), strict=True))
    heads = tokenizer.encode_batch_fast([head for head, _ in cuts], add_special_tokens=False)
    for (_, rest), ids, some, head in zip(cuts, found, gaps, heads, strict=True):
        for k in some:
            ids[k] = now[rest[k]]
        yield np.asarray(head.ids, "<u4").tobytes() + b"".join(ids)
    if len(kept) >= CACHE and 2 * len(new) > sum(len(rest) for _, rest in cuts):
        kept.clear()  # another kind of text
    if len(kept) < CACHE:
        kept.update((k, v) for k, v in now.items() if len(k) <= CACHE_CHARS)


def _pieces(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, most = np.asarray([end], "<u4").tobytes(), 4 * length
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                out = defaultdict(list)
                ids = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), _document_ids(path, [x or "" for x in batch.column("text").to_pylist()]), strict=True)
                for row, doc_id, data in ids:
                    data += tail
                    lead = len(data) % most or most  # only the first piece may be short
                    cuts = [0, *range(lead, len(data) + 1, most)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for name, value in (("row", row), ("doc_id", doc_id), ("piece", k), ("start", a // 4), ("length", (b - a) // 4), ("ids_crc32", zlib.crc32(data[a:b]))):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in (("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths that share a sequence, and how many sequences look so.

    From the longest piece down: a gap is filled exactly by one piece, else by two, else by three, as often as the
    counts allow; what has no exact complement goes where it leaves the least room. Each step uses up a length or
    settles one, so there are about as many patterns as lengths, however many pieces there are.
    """
    left = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    patterns: list[tuple[tuple[int, ...], int]] = []

    def fill(gap: int) -> tuple[int, ...] | None:
        if left[gap] > 0:
            return (gap,)
        there = np.flatnonzero(left[: gap + 1])
        flag = left > 0
        pair = there[(there >= gap - there) & (there < gap)]
        pair = pair[flag[gap - pair]]
        if len(pair):
            return (int(pair[-1]), gap - int(pair[-1]))
        for a in there[::-1]:
            if a * 3 < gap:
                break
            rest = gap - int(a)
            b = there[(there <= a) & (2 * there >= rest) & (there < rest)]
            b = b[flag[rest - b]]
            if len(b):
                return (int(a), int(b[-1]), rest - int(b[-1]))
        return None

    spare: dict[int, int] = {}
    for n in range(length, 0, -1):
        while left[n] > 0:
            gap = length - n
            left[n] -= 1  # the longest itself
            got = fill(gap) if gap else ()
            left[n] += 1
            if got is None:
                spare[n] = int(left[n])
                left[n] = 0
                break
            need = defaultdict(int)
            for x in (n, *got):
                need[x] += 1
            times = min(int(left[x]) // k for x, k in need.items())
            if times == 0:  # a length is needed more often than it is left
                spare[n] = spare.get(n, 0) + int(left[n])
                left[n] = 0
                break
            for x, k in need.items():
                left[x] -= k * times
            patterns.append(((n, *got), times))
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, number]
    for n in sorted(spare, reverse=True):
        todo = spare[n]
        while todo:
            room = next((r for r in sorted(open_) if r >= n), None)
            if room is None:
                per = min(length // n, todo)
                times = todo // per
                open_[length - per * n].append([(n,) * per, times])
                todo -= per * times
                continue
            got = open_[room][-1]
            times = min(todo, got[1])
            got[1] -= times
            if not got[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            open_[room - n].append([(*got[0], n), times])
            todo -= times
    return patterns + [(tuple(p), k) for group in open_.values() for p, k in group]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset): where pieces of a length go."""
    used, sequence, out = defaultdict(int), 0, []
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            out.append((n, used[n] + 1, used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns row, doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A document is its ids and then `end`; null and empty texts are that id alone. Only documents over `length` are cut,
    into full pieces after a first one that may be shorter. Repeated rows are documents of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(row_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stage(rows.mapInArrow(_pieces(tokenizer_path or vocabulary_path(), length, end), "row long, doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    places = spark.createDataFrame(_places(plan(counts, length)) or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(shuffle_partitions(spark))))
    ranked = salted.select("*", F.expr("row_number() over (partition by length, salt order by row, piece)").alias("k"))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.expr("sum(n) over (partition by length order by salt) - n").alias("before"))
    placed = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k"))
    # Bounded: about as many places as lengths, whatever the number of pieces.
    return (
        placed.join(F.broadcast(places), "length")
        .where("rank between low and high")
        .select("row", "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
