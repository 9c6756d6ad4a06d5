"""Secrets in texts: fixed patterns, and strings near sensitive words that zstandard can't compress.

A candidate is a long run of characters as keys have them, with a letter and a digit, shortly after a sensitive word.
What it adds to the compressed size of its surroundings is measured with a compressor that knows a dictionary of code and
of the corpus' own identifiers: names, paths and placeholders add little, random strings add nearly their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import cache

#: Base patterns by kind, in the order in which spans of one start are listed; the group that must be so long at least.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # a run is taken whole, so short ones needn't be looked at
}
NOVEL = "novel"
#: A candidate; sensitive words, and how far before it they may begin; surroundings on each side that it is compressed with.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{16,}={0,2}")
_SENSITIVE = re.compile("password|passwd|passphrase|pwd|secret|token|key|auth|cred|private|bearer|signature|cookie|salt|session|jwt|webhook", re.I | re.A)
NEAR, AROUND = 48, 256
#: Marginal bytes over own bytes from which on a candidate is novel: of hexadecimal digits alone, of others; and of those of LONG bytes, whose digits alone compress to about 4 and 6 bits.
LONG, HEX, OTHER, LONG_HEX, LONG_OTHER = 128, 0.75, 0.9, 0.47, 0.72
#: Pieces of identifiers that the corpus gives to the dictionary at most, and their length.
PIECES, PIECE = 4096, (3, 24)

_CODE = """import from return class function public private static void string int boolean const var let def self config settings environment production staging development
localhost example.com example.org http https www user users username email mail admin root test client server service request response session cookie header authorization
bearer basic password passwd secret token apikey api_key access_token refresh_token secret_key private_key client_secret YOUR_API_KEY YOUR_TOKEN HERE id identifier value name
default account version release license source target index table column data file path directory image document text content message error warning info debug true false null
none undefined new delete update insert select where order group limit and or not in is if else while for switch case break continue try catch finally throw raise yield async
await lambda print format length size count number integer float double array list map set object type interface abstract extends implements package module export require
include define struct enum union template typename namespace using std vector util utils common core main init start stop run build install setup make docker container
database sql queue topic stream java python script html json xml yaml toml ini conf log logs tmp temp cache backup tar.gz zip png jpg pdf txt csv key hash salt auth"""
_PLACEHOLDERS = "0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ qwertyuiopasdfghjklzxcvbnm changeme placeholder deadbeef xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 your- example EXAMPLE"
#: Comes before all surroundings: a compressor that has nothing yet stores what it could refer to.
_LEAD = 'def connect(self):\n    client = Client(host="localhost", port=5432)\n    headers = {"Authorization": "Bearer "}\n    return client.request("GET", url, headers=headers)\n'


def identifiers(docs: DataFrame, text: str = "text") -> list[str]:
    """The PIECES lower-case parts of identifiers (snake_case, camelCase) that most texts have, ties by name. All texts are counted; digits are no part of one, so that no key gets in."""
    name = r"(?<![A-Za-z])(?:[A-Za-z]++(?:_[A-Za-z]++)++|[a-z]++(?:[A-Z][a-z]++)++)"
    names = F.concat_ws(" ", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(name), F.lit(0)))
    parts = F.transform(F.regexp_extract_all(names, F.lit("[A-Z]?[a-z]++|[A-Z]++"), F.lit(0)), F.lower)
    each = docs.select(F.explode(F.array_distinct(parts)).alias("piece")).where(F.length("piece").between(*PIECE))
    return [r.piece for r in each.groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(PIECES).collect()]


class Novelty:
    """A compressor that knows code and the given identifiers, most frequent first."""

    def __init__(self, pieces: list[str]):
        words = _CODE.split()
        dates = [f"{y}-{m:02d}-01T00:00:00.000Z" for y in range(1990, 2040) for m in (1, 12)]
        own = [x for p in reversed(pieces) for x in (p.upper(), p.capitalize(), p)]
        known = "\n".join([*own, *dates, *_PLACEHOLDERS.split(), *(f(w) for f in (str.upper, str.capitalize, str) for w in words)])
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=20, hash_log=16, chain_log=16, search_log=6, target_length=64)
        self.compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)

    def marginal(self, around: str, candidate: str) -> int:
        """Bytes that the candidate adds to its surroundings, in which its copies don't count."""
        rest = (_LEAD + around.replace(candidate, "")).encode("utf-8", "replace")
        return len(self.compressor.compress(rest + b"\n" + candidate.encode())) - len(self.compressor.compress(rest))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the base patterns' matches that are long enough, by start, then kind as listed."""
    found = [(m.start(), k, kind, m.end()) for k, (kind, (pattern, group, least)) in enumerate(KINDS.items()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int]]:
    """Spans of incompressible strings after sensitive words that touch no base span."""
    found = []
    for m in _RUN.finditer(text):
        run = m[0].rstrip(".-~")
        start, end = m.start(), m.start() + len(run)
        if len(run) < 16 or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or not _SENSITIVE.search(text, max(0, start - NEAR), start):
            continue
        if any(s < end and start < e for _, s, e in base):
            continue
        digits = re.fullmatch("[0-9a-fA-F]+", run) is not None
        need = (LONG_HEX if digits else LONG_OTHER) if len(run) >= LONG else (HEX if digits else OTHER)
        if novelty.marginal(text[max(0, start - AROUND) : start] + text[end : end + AROUND], run) >= need * len(run):
            found.append((NOVEL, start, end))
    return found


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, pieces: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for each row of docs; spans are (kind, start, end), in code points, end exclusive, by start, then kind: base ones as listed, novel ones last.

    Null and empty texts have none. Rows of one id, and equal rows, are scanned each. pieces: what identifiers() gives, which is
    the default. An empty table gives no rows. A key that is repeated nearby is novel each time.
    """
    known = identifiers(docs, text) if pieces is None else pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cache("secrets")
        if held.get("pieces") != known:
            held |= {"pieces": known, "novelty": Novelty(known)}
        novelty = held["novelty"]
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                base = base_spans(x or "")
                rows.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(base + novel_spans(x or "", base, novelty), key=lambda s: (s[1], [*KINDS, NOVEL].index(s[0])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in [*KINDS, NOVEL]]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"] != NOVEL)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
