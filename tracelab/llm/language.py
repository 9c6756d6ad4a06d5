"""Language by hierarchical discrimination.

A document's family comes first, from one-versus-one linear support vector machines between families; machines between
the languages of that family then tell those apart. Features are square roots of the shares of hashed character
1-, 2- and 3-grams of the whole lower-cased text. Machines are trained on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 13
#: Documents of a language that train at most: a few for each of SALTS hash classes.
SALTS, PER_SALT = 64, 7
UNKNOWN = "und"
#: Families by ISO 639-1 code. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "bn gu hi mr ne pa sa ur",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].lower(), language)


def features(text: str) -> np.ndarray:
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(2654435761)
    two = one[:-1] + c[1:] * np.uint32(2246822519)
    three = two[:-1] + c[2:] * np.uint32(3266489917)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    total = np.zeros(BUCKETS)
    for grams in (one, two * np.uint32(668265263), three * np.uint32(374761393)):
        total += np.bincount(grams >> shift, minlength=BUCKETS)
    return np.sqrt(total / total.sum())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(x.isalpha() for x in text)


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, of a linear support vector machine, by coordinate descent on the dual."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, a, norm, draw = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1), np.random.default_rng(0)
    for _ in range(rounds):
        for i in draw.permutation(len(x)):
            new = min(cost, max(0.0, a[i] - (y[i] * (w @ x[i]) - 1) / norm[i]))
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


class Machines:
    """One-versus-one machines between classes."""

    def __init__(self, x: np.ndarray, classes: np.ndarray):
        self.names = sorted(set(classes))
        self.pairs = list(combinations(range(len(self.names)), 2))
        self.weights = np.zeros((len(self.pairs), BUCKETS + 1))
        for k, (a, b) in enumerate(self.pairs):
            here = np.isin(classes, [self.names[a], self.names[b]])
            self.weights[k] = _machine(x[here], np.where(classes[here] == self.names[a], 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class with the most votes, a machine's vote being how sure it is; and the mean of those for it."""
        if not self.pairs:
            return self.names[0], 1.0
        sure = 1 / (1 + np.exp(-3 * (self.weights[:, :-1] @ x + self.weights[:, -1])))
        votes = np.zeros(len(self.names))
        for (a, b), p in zip(self.pairs, sure, strict=True):
            votes[a] += p
            votes[b] += 1 - p
        best = int(votes.argmax())
        return self.names[best], float(votes[best] / (len(self.names) - 1))


class Model:
    def __init__(self, x: np.ndarray, languages: np.ndarray):
        families = np.array([family(v) for v in languages])
        self.families = Machines(x, families) if len(x) else None
        self.within = {f: Machines(x[families == f], languages[families == f]) for f in sorted(set(families))}

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        name, sure = self.families.predict(x)
        language, more = self.within[name].predict(x)
        return language, sure * more


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, features(text).astype(np.float16).tobytes()) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if has_letter(text)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())], ["lang", "x"])


def train(labelled: DataFrame) -> Model:
    """A model of labelled rows (doc_id, text, lang). Rows without lang, text or letters teach nothing; of an id that is repeated with one lang, the smallest text does."""
    rank = "row_number() over (partition by lang, salt order by h, doc_id)"
    ids = labelled.where("lang is not null and doc_id is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    chosen = ids.select("lang", "doc_id", F.expr(rank).alias("k")).where(F.col("k") <= PER_SALT).drop("k")
    # Bounded: SALTS * PER_SALT ids a language.
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = texts.select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    found.sort()
    x = np.array([np.frombuffer(r.x, np.float16) for r in found], np.float64).reshape(-1, BUCKETS)
    return Model(x, np.array([r.lang for r in found], dtype=object))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, lang_pred, score: one row for each of docs. Null texts and texts without letters are `und`, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights a bucket for each pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
