"""Token counts without token ids: pieces are counted once per distinct pre-token and summed per document.

A pre-token here is what lies between two places where the tokenizer's own pattern always cuts (before a
space that follows no white space), so counts of pre-tokens add up to the count of the text. The corpus
gives a table of distinct pre-tokens; each is encoded once. The most frequent ones, at most COMMON, go to
all tasks as a broadcast of bounded size; the others are rare by the choice of that bound, and documents'
frequencies of them are joined with the table by a shuffle without hot keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import row_id, stage
from tracelab.llm.tokenizer import cut, load, vocabulary_path

#: Most pre-tokens that are broadcast, and the characters that one of them may have: at most 13 MB of text.
COMMON, COMMON_CHARS = 200_000, 64
#: A pre-token longer than this is counted on the spot: it is as good as unique.
LONG = 256


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pre-token occurs, summed over some hundred thousand of them at a time."""
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({"piece": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(x for x in cut(text or "") if len(x) <= LONG)
            if len(seen) >= 500_000:
                yield out()
    yield out()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            found = tokenizer.encode_batch(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array([len(x.ids) for x in found], pa.int32())], ["piece", "n", "tokens"])

    return run


def _documents(path: str, common):
    """Of each document: tokens of its common and of its very long pre-tokens, and the frequencies of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokenizer = common.value, load(path)
        for batch in batches:
            done, names, counts = [], [], []
            for text in batch.column("text").to_pylist():
                total, rare = 0, {}
                for piece, n in Counter(cut(text or "")).items():
                    if (k := known.get(piece)) is not None:
                        total += n * k
                    elif len(piece) > LONG:
                        total += n * len(tokenizer.encode(piece, add_special_tokens=False).ids)
                    else:
                        rare[piece] = n
                done.append(total)
                names.append(list(rare))
                counts.append(list(rare.values()))
            keep = [batch.column(c) for c in ("row", "doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(done, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["row", "doc_id", "n_bytes", "done", "pieces", "counts"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns row, doc_id, n_bytes, n_tokens: one row for each row of docs, repeated rows and null ids included.

    Null and empty texts have no bytes and no tokens; an empty table gives no rows. Other columns of docs are not read.
    """
    spark, path = docs.sparkSession, tokenizer_path or vocabulary_path()
    pieces = docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    table = stage(pieces.mapInArrow(_encode(path), "piece string, n long, tokens int"), "pre-tokens")
    level = F.floor(F.log2("n") * 8)
    short = table.where(F.length("piece") <= COMMON_CHARS)
    least, room = None, COMMON
    for step, n in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):  # a few hundred levels
        if n > room:
            break
        least, room = step, room - n
    common = {} if least is None else {r.piece: r.tokens for r in short.where(level >= least).select("piece", "tokens").toLocalIterator()}
    rows = docs.select(row_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    known = spark.sparkContext.broadcast(common)
    base = stage(rows.mapInArrow(_documents(path, known), "row long, doc_id long, n_bytes long, done long, pieces array<string>, counts array<long>"), "token-counts")
    rare = base.select("row", F.explode(F.arrays_zip("pieces", "counts")).alias("x")).select("row", F.col("x.pieces").alias("piece"), F.col("x.counts").alias("count"))
    tail = table if least is None else table.where((F.length("piece") > COMMON_CHARS) | (level < least))
    summed = rare.join(tail.select("piece", "tokens"), "piece").groupBy("row").agg(F.sum(F.col("count") * F.col("tokens")).alias("rest"))
    return base.drop("pieces", "counts").join(summed, "row", "left").select("row", "doc_id", "n_bytes", (F.col("done") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
