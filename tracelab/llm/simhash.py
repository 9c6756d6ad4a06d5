"""SimHash near-duplicates by the generalised pigeonhole principle.

If two fingerprints differ in at most `most` bits and the bits are split into m parts with thresholds that add up to
most - m + 1, then in at least one part they differ by no more than its threshold. Correlated bits are put in one part;
the number of parts and their unequal thresholds come from a dynamic programme on the numbers of rows and candidates
that bit statistics of all fingerprints let expect. Work is on distinct fingerprints: copies are never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm.common import attach, free_name, row_id, short, stage
from tracelab.llm.components import components
from tracelab.llm.rolling import Rolling

BITS, SEED = 64, 42
#: In a fuller bucket, comparing all pairs costs more than the way around it below.
FULL = 128


def shingles(text: bytes, n: int) -> list[bytes]:
    """Runs of n words joined by a space, repeats included; the whole sequence of fewer words; nothing of none. A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words)) - 1
    return [line[a:b] for a, b in zip(starts[: len(starts) - k].tolist(), ends[k:].tolist(), strict=True)]


def fingerprint(grams: list[bytes]) -> int:
    """Bits that are set in over half of the hashes; 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(grams), 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in grams[k : k + (1 << 16)]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, grams: Callable[[bytes], list[bytes]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and fp, a signed long with the bits of each row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(grams(x or b"")) for x in batch.column("_bytes").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.int64())], [*keep, "fp"])

    rows = docs.select(*keep, F.encode(F.col(text), "UTF-8").alias("_bytes"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_bytes") + ", fp long")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(total.reshape(-1))], ["cell", "n"])


def _parts(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, each grown from the bit that correlates most by those that correlate most with the group."""
    share = np.diag(together) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((together / n - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(free, key=lambda b: (tie[b, list(free)].sum(), -b))]
        while len(group) < size:
            group.append(max(free - set(group), key=lambda b: (tie[b, group].sum(), -b)))
        free -= set(group)
        out.append(sorted(group))
    return out


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def allocate(together: np.ndarray, n: int, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are used: the cheapest way to meet the pigeonhole bound, for 1 to most + 2 parts.

    A part with threshold t costs the rows of two balls, of radius t // 2 in the index and the rest in the probe, and
    the candidates: pairs expected within t, from the chance that two fingerprints differ in each bit.
    """
    share = np.diag(together) / n
    best = (float("inf"), [])
    for m in range(1, min(most + 2, 6) + 1):
        parts = _parts(together, n, m)
        costs = []
        for bits in parts:
            near = np.zeros(most + 2)
            near[0] = 1.0
            for d in 2 * share[bits] * (1 - share[bits]):
                near[1:] = near[1:] * (1 - d) + near[:-1] * d
                near[0] *= 1 - d
            costs.append([0.0] + [n * (_ball(len(bits), t // 2) + _ball(len(bits), t - t // 2)) + n * n / 2 * near[: t + 1].sum() for t in range(most + 1)])
        goal = most - m + 1  # thresholds from -1, unused, up
        table = {0: (0.0, [])}  # sum of thresholds + 1 so far -> cost, thresholds
        for cost in costs:
            table = {
                s: min((c + cost[t + 1], [*ts, t]) for used, (c, ts) in table.items() for t in range(-1, most + 1) if used + t + 1 == s)
                for s in {used + t + 1 for used in table for t in range(-1, most + 1) if used + t + 1 <= goal + m}
            }
        total, thresholds = table[goal + m]
        best = min(best, (total, [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0]))
    return best[1]


def _keys(fps: DataFrame, parts: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """(part, z, fp): the values within the part's radius of a fingerprint's bits in it."""
    out = None
    for k, (bits, t) in enumerate(parts):
        radius = t - t // 2 if probe else t // 2
        mask = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)]
        signed = np.array([mask, *flips], np.uint64).view(np.int64).tolist()
        base = F.col("fp").bitwiseAND(F.lit(signed[0]))
        spread = fps.select("fp", F.explode(F.lit(signed[1:])).alias("flip"))
        one = spread.select(F.lit(k).alias("part"), base.bitwiseXOR(F.col("flip")).alias("z"), "fp")
        out = one if out is None else out.unionByName(one)
    return out


def _near(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def _balls(members: DataFrame) -> DataFrame:
    """Links of fingerprints within 2 bits, by the values that are at most one bit from both: no value has over 65 around it."""
    flips = np.array([0, *(1 << k for k in range(BITS))], np.uint64).view(np.int64).tolist()
    around = members.select("fp", F.explode(F.lit(flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    met = around.groupBy("v").agg(F.sort_array(F.collect_list("fp")).alias("g")).where(F.size("g") > 1)
    return met.select(F.col("g")[0].alias("a"), F.explode(F.slice("g", 2, BITS + 1)).alias("b"))


def links(fps: DataFrame, most: int) -> DataFrame:
    """Columns a, b: links between distinct fingerprints (column fp, staged) that differ in at most `most` bits, enough to connect all that are linked.

    Within 2 bits, buckets of over FULL members, where pairs would grow with the square, give links with the same
    components by values one bit from both. With more bits every linked pair is given, whatever a bucket's size.
    """
    n = fps.count()
    cells = fps.select("fp").mapInArrow(_bit_counts, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    together = np.zeros(BITS * BITS)
    together[cells["cell"]] = cells["n"]
    parts = allocate(together.reshape(BITS, BITS), max(1, n), most)
    index, probe = _keys(fps, parts, probe=False), _keys(fps, parts, probe=True)
    near = lambda some: some.withColumnRenamed("fp", "a").join(probe.withColumnRenamed("fp", "b"), ["part", "z"]).where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"), most)).select("a", "b").distinct()
    if most > 2:
        return near(index)
    sizes = stage(index.groupBy("part", "z").agg(F.count("*").alias("n")).where("n > 1 or " + ("false" if all(t == 0 for _, t in parts) else "true")), "buckets")
    full = sizes.where(F.col("n") > FULL).select("part", "z")
    members = index.unionByName(probe).join(full, ["part", "z"], "left_semi")
    return near(index.join(sizes.where(F.col("n") <= FULL).select("part", "z"), ["part", "z"])).unionByName(_balls(members.select("fp").distinct()))


def near_groups(rows: DataFrame, most: int, doc_id: str = "doc_id") -> DataFrame:
    """Staged rows (doc_id, fp, ...) with component_id, the smallest id that is reached by links. Null ids count only where a group has no other. An empty table gives no rows."""
    groups = stage(rows.groupBy("fp").agg(F.min(doc_id).alias("first"), F.count("*").alias("rows_of_fp")), "fingerprints")
    linked = components(links(groups.select("fp"), most))
    roots = groups.join(linked.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "first", "rows_of_fp", F.coalesce("b", "fp").alias("root"))
    roots = stage(roots, "roots")
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps"))
    known = stage(attach(roots, ids, "root", "fps", roots.count()).select("fp", "rows_of_fp", "component_id"), "classes")
    return attach(rows, known, "fp", "rows_of_fp", rows.count()).drop("rows_of_fp")


#: Words of the shingles that set a fingerprint's bits, and in how many bits those of near copies differ at most.
GRAM, MOST = 3, 2
#: Similarity of the sets of WORDS-word shingles from which two documents are near copies.
WORDS, SIMILAR = 5, 0.8
#: Documents that tell which shingles are frequent, in how many of them one must be, and how many such shingles are kept.
SAMPLE, OFTEN, FREQUENT = 40_000, 3, 500_000
#: A shingle of so many sampled documents is hot: its rows are dealt to SALTS groups, each with its own head.
HOT, SALTS = 40, 64
#: Rows of a group that all its others are compared with before the rest is: in a family of texts of which few pairs are similar, one wouldn't connect much.
HEADS = 64
_ODD = 0x00F42D4C957F2D51


def _shingle_set(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles; of the whole sequence of fewer words; none without words. A-Z count as a-z."""
    words = (text or b"").lower().split()
    return np.unique(Rolling(words, "shingles").runs(min(WORDS, len(words)))) if words else np.empty(0, np.uint64)


def _lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    """A column of lists of numbers, without an object for each."""
    ends = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(kind)))


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as shingles take more room than their texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        sets = [_shingle_set(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(sets)], ["row", "grams"])


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled documents, rarer ones first, and in how many of them each is.

    They only order the prefixes and deal out work: any order finds every pair.
    """
    part = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(part)) == 0).mapInArrow(_shingle_sets, "row long, grams array<long>")
    counts = some.select(F.explode("grams").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    return found["h"].to_numpy(np.int64)[::-1].copy().view(np.uint64), found["n"].to_numpy(np.int64)[::-1].copy()


def _parities(grams: np.ndarray) -> np.ndarray:
    """For each value of the hashes' low bits whether an odd number of hashes has it, in words of 64; about as many bits as there are hashes."""
    n = max(64, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _at_least_unlike(x: Column, y: Column) -> Column:
    """A lower bound of the number of shingles that just one of two sets has: the bits in which their parities differ. The longer ones are folded to the shorter ones' length."""
    half = lambda v, k: F.slice(v, F.lit(1) + k * (F.size(v) / 2).cast("int"), (F.size(v) / 2).cast("int"))
    fold = lambda v: F.zip_with(half(v, 0), half(v, 1), lambda a, b: a.bitwiseXOR(b))
    a, b = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x), F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)


def _prefixes(frequent: np.ndarray, times: np.ndarray):
    """Size, digest and parities of a document's set, its first shingles, and the places of hot ones among these.

    Two sets that are similar enough share one of the first shingles, as all sets are put in the same order.
    """
    order = np.argsort(frequent)
    known, hot = frequent[order], times[order] >= HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sizes, digests, firsts, hots, bits = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                grams = _shingle_set(text)
                place, is_hot = np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    same = known[at] == grams
                    place, is_hot = np.where(same, order[at] + 1, 0), same & hot[at]
                long = len(grams) - int(np.ceil(SIMILAR * len(grams) - 1e-6)) + 1
                first = np.argsort(place, kind="stable")[:long]  # the set itself is sorted
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                firsts.append(grams[first])
                hots.append(np.flatnonzero(is_hot[first]).astype(np.int32))
                bits.append(_parities(grams))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), _lists(bits), _lists(firsts), _lists(hots, np.int32)], ["row", "n", "digest", "bits", "firsts", "hots"])

    return run


def _may_reach(a_n: Column, a_pos: Column, b_n: Column, b_pos: Column) -> Column:
    """False if sets of these sizes whose first common shingle is at these places (from 0) can't be similar enough."""
    return F.least(a_n - a_pos, b_n - b_pos) >= SIMILAR / (1 + SIMILAR) * (a_n + b_n) - 1e-6


def _size(rest: str) -> Column:
    """The size of the set, of near_links' column with size, place and whether the shingle is hot."""
    return F.shiftright(rest, 32).cast("int")


def _place(rest: str) -> Column:
    return F.shiftright(rest, 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _with_partner(rows: DataFrame, group: Window, among: Column, name: str) -> DataFrame:
    """rows with a column that tells whether a row of `among` may be similar enough, as _may_reach has it, to another of these in its group; true for more rows, never for fewer.

    A row reaches sizes (times a constant, `own`) up to `far`, and two have to reach each other. So the largest far and the
    smallest own of the others decide; of the row that has it alone, the next.
    """
    share = SIMILAR / (1 + SIMILAR)
    far, own, most, least = (F.col(c) for c in ("_far", "_own", "_most", "_least"))
    ends = rows.withColumns({"_far": F.when(among, _size("rest") * (1 - share) - _place("rest") + 2e-6), "_own": F.when(among, _size("rest") * share)})
    ends = ends.withColumns({"_most": F.max(far).over(group), "_least": F.min(own).over(group)})
    last, first = (far == most) & (F.count_if(far == most).over(group) == 1), (own == least) & (F.count_if(own == least).over(group) == 1)
    others_far = F.when(last, F.max(F.when(far < most, far)).over(group)).otherwise(most)
    others_own = F.when(first, F.min(F.when(own > least, own)).over(group)).otherwise(least)
    return ends.withColumn(name, F.coalesce((others_far >= own) & (others_own <= far), F.lit(False))).select(*rows.columns, name)


def similar_pairs(pairs: DataFrame, texts: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of rows whose sets of shingles have at least that Jaccard similarity.

    texts: (row, text as bytes); sets: (row, n, bits). Sizes and parities rule most pairs out, so that whole sets are
    compared for few.
    """
    side = lambda name: sets.select(F.col("row").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))
    unlike = _at_least_unlike(F.col("a_bits"), F.col("b_bits"))
    sized = F.least("a_n", "b_n") >= F.lit(least) * F.greatest("a_n", "b_n") - 1e-6
    open_ = pairs.join(side("a"), "a").join(side("b"), "b").where(sized).where(unlike <= F.lit((1 - least) / (1 + least)) * (F.col("a_n") + F.col("b_n")) + 1e-6).select("a", "b")
    open_ = stage(open_, "open-pairs")
    wanted = stage(open_.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "wanted")
    whole = stage(texts.join(short(wanted), "row", "left_semi").mapInArrow(_shingle_sets, "row long, grams array<long>"), "shingle-sets")
    both = open_.join(whole.select(F.col("row").alias("a"), F.col("grams").alias("x")), "a").join(whole.select(F.col("row").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def fingerprint_links(fps: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Columns a, b: links between rows whose fingerprints differ in at most MOST bits, those whose sets of shingles are similar enough.

    fps: staged (row, fp). Rows of a fingerprint are dealt to SALTS groups and compared with the first of their group, and
    these with the first of all, which stands for the fingerprint where it is linked with others.
    """
    dealt = fps.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    groups = stage(dealt.groupBy("fp", "salt").agg(F.min("row").alias("head")), "fingerprint-groups")
    heads = stage(groups.groupBy("fp").agg(F.min("head").alias("first")), "fingerprint-heads")
    between = links(heads.select("fp"), MOST)
    one = lambda c: heads.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_row"))
    pairs = [
        dealt.join(groups, ["fp", "salt"]).select(F.col("row").alias("x"), F.col("head").alias("y")),
        groups.join(heads, "fp").select(F.col("head").alias("x"), F.col("first").alias("y")),
        between.join(one("a"), "a").join(one("b"), "b").select(F.col("a_row").alias("x"), F.col("b_row").alias("y")),
    ]
    met = reduce(DataFrame.unionByName, pairs).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return stage(similar_pairs(stage(met, "fingerprint-pairs"), texts, sets), "fingerprint-links")


def near_links(sets: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Columns a, b: links that, with the known ones, connect all rows whose sets of shingles are similar enough, by all pairs that share a prefix shingle.

    sets: (row, n, bits, firsts, hots) of distinct sets; texts: (row, text as bytes); known: staged links (a, b), whose rows
    aren't compared again. Entries that, by sizes and places, can be similar to no other of their shingle are left out. The first row of each shingle is compared with all its others, then the first HEADS are with those that this has not connected with them, then, in larger
    groups, all that are still apart are with each other. Rows of a hot shingle are dealt to groups with heads of their own,
    and first heads are compared with that of all. The rows of a shingle are in the order of its place in their prefixes: a
    text in the middle of a family has few shingles of its own before those of the family, so that it becomes a head.
    """
    entries = sets.where("n > 0").select("row", "n", "hots", F.posexplode("firsts").alias("pos", "h"))
    # Three longs a shingle: the group that it falls to, the row, and the rest in one.
    salt = F.lit(_ODD) * F.pmod(F.xxhash64("row"), F.lit(SALTS))
    hot = F.array_contains("hots", F.col("pos"))
    entries = entries.select("row", F.when(hot, F.col("h").bitwiseXOR(salt)).otherwise(F.col("h")).alias("g"), (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos") * 2 + hot.cast("int")).alias("rest"))
    group = Window.partitionBy("g")
    place = _place
    is_hot = F.col("rest") % 2 == 1
    many = F.count("*").over(group).alias("many")
    rows = entries.select("*", many).where((F.col("many") > 1) | is_hot).drop("many")
    rows = _with_partner(rows, group, F.lit(True), "partner").where(F.col("partner") | is_hot)
    rows = rows.select("row", "g", "rest", F.row_number().over(group.orderBy(place("rest"), "row")).alias("k"), many).where((F.col("many") > 1) | is_hot)
    # The first of a group is compared with all others at once: only the others, by pairs of their own, are met again.
    shared = stage(_with_partner(rows, group, F.col("k") > 1, "again").withColumn("again", F.col("again") | is_hot), "shared-shingles")

    def met(x: DataFrame, y: DataFrame, on: str, more: Column) -> DataFrame:
        """Distinct pairs (a, b) of a row of x and one of y with one value of a column, the smaller row first, that may be similar enough."""
        reach = _may_reach(_size("x.rest"), place("x.rest"), _size("y.rest"), place("y.rest"))
        pairs = x.alias("x").join(y.alias("y"), (F.col(f"x.{on}") == F.col(f"y.{on}")) & reach & more)
        return pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()

    def placed(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        roots = components(links).select(F.col("a").alias("row"), F.col("b").alias("root"))
        return stage(rows.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), name)

    other, apart = F.col("x.row") != F.col("y.row"), F.col("x.root") != F.col("y.root")
    after = F.struct("x.k", "x.row") > F.struct("y.k", "y.row")  # each pair of heads once
    whole = F.when(is_hot, F.col("g").bitwiseXOR(salt)).otherwise(F.col("g")).alias("h")
    first = shared.where(is_hot & (F.col("k") == 1)).select("row", "rest", whole)
    top = first.groupBy("h").agg(F.min(F.struct(place("rest").alias("place"), "row", "rest")).alias("t")).select("h", "t.row", "t.rest")
    stars = met(shared.where("k > 1"), shared.where("k = 1"), "g", other).unionByName(met(first, top, "h", other)).distinct()
    linked = short(components(known))
    for c in ("a", "b"):
        stars = stars.join(linked.select(F.col("a").alias(c), F.col("b").alias(f"{c}_root")), c, "left")
    stars = stars.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    found = stage(known.unionByName(similar_pairs(stage(stars, "near-stars"), texts, sets)), "near-star-links")
    once = placed(shared.where("again").select("row", "rest", "k", "many", whole), found, "near-roots")
    more = met(once, once.where(F.col("k") <= F.when(is_hot, 1).otherwise(HEADS)), "h", apart & after)  # of a hot shingle, the first of each group
    found = stage(found.unionByName(similar_pairs(stage(more, "near-heads"), texts, sets)), "near-head-links")
    twice = placed(once.where((F.col("many") > HEADS) | is_hot).select("row", "rest", "h"), found, "near-rest")
    return found.unionByName(similar_pairs(stage(met(twice, twice, "h", apart & (F.col("x.row") > F.col("y.row"))), "near-pairs"), texts, sets))


def near_classes(texts: DataFrame) -> DataFrame:
    """Columns a, b: the smallest row b of each row a's group of near copies, for rows that aren't the smallest themselves. texts: staged (row, text as bytes).

    Fingerprints link rows first, each link checked by the sets; shared shingles then link what fingerprints of so few bits miss.
    """
    sets = stage(texts.mapInArrow(_prefixes(*_frequent(texts)), "row long, n int, digest binary, bits array<long>, firsts array<long>, hots array<int>"), "near-sets")
    groups = stage(sets.groupBy("digest").agg(F.min("row").alias("head"), F.count("*").alias("rows")).where("rows > 1"), "near-groups")
    equal = stage(attach(sets.select("row", "digest"), groups, "digest", "rows", sets.count()).where("row <> head").select(F.col("row").alias("a"), F.col("head").alias("b")), "near-equal")
    copies = short(equal.select(F.col("a").alias("row")))
    distinct = sets.join(copies, "row", "left_anti")
    fps = fingerprints(texts.select("row", F.col("text").cast("string").alias("text")), lambda x: shingles(x, GRAM), keep=("row",))
    known = fingerprint_links(stage(fps.join(copies, "row", "left_anti"), "near-fingerprints"), texts, distinct)
    return components(near_links(distinct, texts, known).unionByName(equal))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of docs with all columns, one of each group of near copies: the one with the smallest id, null ids last.

    Groups are the components of all pairs with SIMILAR of their distinct shingles in common. Rows with one set of
    shingles are copies and only the first of them is compared with others. Of documents without words (null, empty or
    white space) one stays. Repeated rows are copies. An empty table gives no rows. Columns of any name are kept as they are.
    """
    row = free_name(docs, "row")
    staged = stage(docs.withColumn(row, row_id()), "near-input")
    ids = staged.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"))
    texts = staged.select(F.col(row).alias("row"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text"))
    joined = near_classes(texts)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    members = joined.select(F.col("a").alias("row"), F.col("b").alias("root")).unionByName(joined.select(F.col("b").alias("row"), F.col("b").alias("root")).distinct()).join(ids, "row")
    kept = members.groupBy("root").agg(first.alias("x")).select(F.col("x.row").alias("row"))
    gone = stage(members.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row)), "near-copies")
    return staged.join(short(gone), row, "left_anti").select(*docs.columns)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(fingerprints(docs, lambda x: shingles(x, GRAM)), "fingerprints-of-rows")
    out = near_groups(rows, MOST)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
