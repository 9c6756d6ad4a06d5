"""Removal of long repeats by fixed-block anchors.

Texts are cut into reference blocks of BLOCK words that don't overlap. Any run of 2 * BLOCK - 1 words holds a whole block
of its document, so two documents that share a window of WINDOW words meet in a block of either. Blocks are indexed by an
anchor, the smallest hash of GRAM words within, and every rolling window of BLOCK words probes with its own; neighbouring
windows mostly share an anchor, so a run of them is one probe and just a tenth of the words' number goes through the
shuffle. Anchors that lie in an indexed block and in two different texts are hits. Around hits, windows of WINDOW words are
compared by hash, and those that a smaller document has too are joined to maximal exact repeats, which are cut out.
No pairs of documents are made: each step needs of a hash only the smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import HOT_SHARE, attach, stage
from tracelab.llm.rolling import Rolling

WINDOW, BLOCK, GRAM = 50, 25, 8
#: To how many tasks the rows of a hot anchor or window go.
SALTS = 64
_LAST = (1 << 63) - 1


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes split at 20 and 09 to 0D, as the contract has it


def _anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, whether a block begins among them) of each run of windows with one anchor."""
    if len(words) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    grams = Rolling(words, "substrings").runs(GRAM)
    at = np.lib.stride_tricks.sliding_window_view(grams, BLOCK - GRAM + 1).argmin(1)
    at += np.arange(len(at))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return grams[at[first]].view(np.int64), first, last, first + -first % BLOCK <= last


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for k in range(0, big.num_rows, 1024):
            batch = big.slice(k, 1024)
            n, digests, anchors, spans, blocks = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                a, first, last, block = _anchors(words)
                anchors.append(a)
                spans.append(first << 16 | np.minimum(last - first, 0xFFFF))
                blocks.append(block)
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]), pa.int32()), pa.array(np.concatenate(x), t))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists(anchors, pa.int64()), lists(spans, pa.int64()), lists(blocks, pa.bool_())], ["ord", "key", "n_words", "digest", "anchor", "span", "block"])


def _starts(spans: list[int], n: int) -> np.ndarray:
    """First words of the windows of WINDOW words that hold a window of BLOCK words from the spans."""
    marks = np.zeros(n + 1, np.int32)
    for s in spans:
        first, length = s >> 16, s & 0xFFFF
        marks[max(0, first - (WINDOW - BLOCK))] += 1
        marks[min(n, first + length + 1)] -= 1
    return np.flatnonzero(np.cumsum(marks)[: n - WINDOW + 1])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for k in range(0, big.num_rows, 256):
            batch = big.slice(k, 256)
            out = [[], [], [], []]
            for row, order, text, spans in zip(*(batch.column(c).to_pylist() for c in ("row", "ord", "text", "spans")), strict=True):
                words = _words(text)
                starts = _starts(spans, len(words))
                if len(starts):
                    for to, value in zip(out, (Rolling(words, "substrings").runs(WINDOW)[starts].view(np.int64), np.full(len(starts), order), np.full(len(starts), row), starts), strict=True):
                        to.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["h", "ord", "row", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for k in range(0, big.num_rows, 256):
            batch = big.slice(k, 256)
            removed, kept = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = _words(text)
                marks = np.zeros(len(words) + 1, np.int32)
                np.add.at(marks, starts, 1)
                np.add.at(marks, np.asarray(starts) + WINDOW, -1)
                gone = np.cumsum(marks)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("copies"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["unit", "copies", "n_removed", "kept"])


def _meet(rows: DataFrame, groups: DataFrame, key: str, how: str) -> DataFrame:
    """rows join groups on key, where groups has one row a key and its number of rows in n. Rows of a key with over
    1/HOT_SHARE of them, of which there are fewer than HOT_SHARE, are dealt to SALTS tasks."""
    share = max(1, (groups.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col("n") > share).select(key, F.lit(SALTS).alias("salts")))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("salts", F.lit(1)))).drop("salts")
    salts = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("n") > share, SALTS - 1).otherwise(0).cast("bigint"))
    return dealt.join(groups.withColumn("salt", F.explode(salts)).drop("n"), [key, "salt"], how).drop("salt")


def cut_units(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Like remove_repeats(), but cuts has one row a unit: unit, copies (rows of docs that are this unit), n_removed, kept.

    A unit is an id with a text; the row that stands for it in `unit` of rows takes part in the search, and all are cut alike.
    """
    i, t = F.col(doc_id).cast("long"), F.encode(F.col(text), "UTF-8")
    named = docs.select(F.coalesce(i, F.lit(_LAST)).alias("ord"), F.coalesce(F.xxhash64(i, t), F.lit(0)).alias("key"), t.alias("text"))
    scanned = named.mapInArrow(_scan, "ord long, key long, n_words long, digest binary, anchor array<long>, span array<long>, block array<boolean>")
    scanned = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    total = scanned.count()
    groups = scanned.groupBy("digest").agg(F.min("ord").alias("first"), F.count("*").alias("same"))
    named_as = F.struct("ord", "key").alias("name")
    units = stage(scanned.groupBy(named_as).agg(F.min("row").alias("unit"), F.count("*").alias("copies")), "units")
    rows = attach(scanned.select("row", named_as, "n_words", "digest"), units, "name", "copies", total)
    rows = attach(rows, groups, "digest", "same", total)
    rows = stage(rows.withColumn("whole", (F.col("first") < F.col("name.ord")) & (F.col("n_words") >= WINDOW)).drop("first", "same"), "rows")

    probes = scanned.select("row", F.xxhash64("digest").alias("content"), F.explode(F.arrays_zip("anchor", "span", "block")).alias("x"))
    probes = probes.select("row", "content", F.col("x.anchor").alias("anchor"), F.col("x.span").alias("span"), F.col("x.block").alias("block"))
    hits = probes.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("block").alias("indexed"), F.count("*").alias("n")).where("indexed and lo < hi")
    hits = stage(hits.select("anchor", "n"), "hits")
    spans = _meet(probes.select("row", "anchor", "span"), hits, "anchor", "left_semi").groupBy("row").agg(F.collect_list("span").alias("spans"))
    searched = rows.where("row = unit and not whole").select("row", "copies", "name.ord", "name.key")
    found = searched.join(spans, "row").select("ord", "key", F.col("row").alias("unit"), "copies", "spans")
    # Of units with over 1/HOT_SHARE of all rows, of which there are fewer than HOT_SHARE, each task sends one text. The join sees each
    # other unit's rows in order, so that the first of them is taken without another shuffle.
    often = units.where(F.col("copies") > max(1, total // HOT_SHARE)).select("name.ord", "name.key")
    if not often.isEmpty():
        once = named.join(F.broadcast(often), ["ord", "key"], "left_semi").groupBy("ord", "key").agg(F.first("text").alias("text"))
        named = named.join(F.broadcast(often), ["ord", "key"], "left_anti").unionByName(once)
    taken = [F.first(c).alias(c) for c in ("unit", "copies", "text", "spans")]
    texts = stage(named.join(found, ["ord", "key"]).groupBy("ord", "key").agg(*taken), "candidates")

    windows = stage(texts.withColumnRenamed("unit", "row").mapInArrow(_windows, "h long, ord long, row long, start int"), "windows")
    held = windows.groupBy("h").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    held = stage(held.select("h", "lo", "n"), "held")
    repeated = _meet(windows, held, "h", "inner").where("lo < ord").groupBy(F.col("row").alias("unit")).agg(F.collect_set("start").alias("starts"))
    cuts = texts.select("unit", "copies", "text").join(repeated, "unit").mapInArrow(_cut, "unit long, copies long, n_removed long, kept binary")
    ord_ = F.col("name.ord")
    return rows.select("row", "unit", F.when(ord_ != _LAST, ord_).alias("doc_id"), "n_words", "digest", "whole"), cuts


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows has doc_id, row, unit, n_words, digest (SHA-256 of its words) and whole (all its words repeat) for
    each row of docs; cuts has row, n_removed and kept (the words that stay, as UTF-8) for those that lose a part.

    A text whose words all equal a smaller document's is settled by its digest and takes no part in the search. Null text
    has no words; texts under WINDOW words lose none. Null ids come after all others, and don't cut each other. Rows
    repeated under one id, and different texts under it, are one document. An empty table gives no rows.
    """
    rows, cuts = cut_units(docs, text, doc_id)
    cuts = stage(cuts.withColumnRenamed("copies", "n"), "cuts")
    return rows, _meet(rows.where(~F.col("whole")).select("unit", "row"), cuts, "unit", "inner").drop("unit")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cuts = cut_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cuts = stage(cuts.select("unit", "copies", "n_removed", F.sha2("kept", 256).alias("cut_sha256")), "cuts")
    out = attach(rows, cuts, "unit", "copies", rows.count())
    removed = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", F.lower(F.hex("digest"))))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


SQL = """
with split as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') as words from documents
), words as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from split
), runs as (
  select doc_id, pos, array_to_string(list(word) over (partition by doc_id order by pos rows between current row and 49 following), ' ') as run, count(*) over (partition by doc_id order by pos rows between current row and 49 following) as n from words
), owners as (
  select run, min(doc_id) as least from runs where n = 50 group by run
), starts as (
  select r.doc_id, r.pos from runs r join owners o using (run) where r.n = 50 and o.least < r.doc_id
), flagged as (
  select w.doc_id, w.pos, w.word, max(s.pos) over (partition by w.doc_id order by w.pos rows between 49 preceding and current row) is not null as gone
  from words w left join starts s on s.doc_id = w.doc_id and s.pos = w.pos
), cut as (
  select doc_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (where not gone), '') as kept from flagged group by doc_id
)
select s.doc_id, cast(len(s.words) as bigint) as n_words, coalesce(c.n_removed, 0) as n_removed, sha256(coalesce(c.kept, '')) as kept_sha256
from split s left join cut c using (doc_id)
"""
