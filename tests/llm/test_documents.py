"""Every operator on documents with odd cases, against a brute-force version, and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, documents
from tracelab.llm import exact_dedup, language, media, mixing, packing, quality, simhash, substrings, token_counts
from tracelab.llm.common import scratch, stage
from tracelab.llm.tokenizer import cut, encode_pieces, load, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in documents()]


def bag(items):
    return Counter(items)


def test_cut_keeps_text_and_tokens(rows):
    tokenizer = load(vocabulary_path())
    for _, text in rows:
        pieces = cut(text or "")
        assert "".join(pieces) == (text or "")
        assert [i for p in pieces for i in tokenizer.encode(p, add_special_tokens=False).ids] == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, empty, rows):
    tokenizer = load(vocabulary_path())
    want = bag((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert bag((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs).collect()) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_with_rare_pre_tokens(docs, rows, monkeypatch):
    """With almost no broadcast, pre-tokens go through the join and give the same."""
    monkeypatch.setattr(token_counts, "COMMON", 3)
    tokenizer = load(vocabulary_path())
    assert sum(r.n_tokens for r in token_counts.count_tokens(docs).collect()) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows)


def test_exact_dedup(spark, docs, empty, rows):
    index = exact_dedup.DigestIndex.open(spark, scratch(spark, "index"), 4)
    out = exact_dedup.ingest(docs, index, "a").collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()].append(i)
    assert len(out) == len(rows)
    for r in out:
        ids = groups[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    kept = Counter(bytes(r.digest) for r in out if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    again = exact_dedup.ingest(docs, index, "b").collect()
    assert not any(r.kept for r in again) and {bytes(r.digest): r.keep_id for r in again} == {bytes(r.digest): r.keep_id for r in out}
    retaken = exact_dedup.ingest(docs, index, "a").collect()
    assert bag((r.doc_id, r.kept) for r in retaken) == bag((r.doc_id, r.kept) for r in out)
    assert exact_dedup.ingest(empty, index, "c").count() == 0
    whole = exact_dedup.deduplicate(docs)
    assert whole.columns == docs.columns and whole.count() == len(groups)


def test_indexes_leave_no_tables_and_open_again(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    path = scratch(spark, "index-again")
    index = exact_dedup.DigestIndex.open(spark, path)
    first = exact_dedup.ingest(docs, index, "a")
    index.close()
    exact_dedup.deduplicate(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    kept = first.where("kept").count()
    index = exact_dedup.DigestIndex.open(spark, path)
    assert index.read().count() == kept > 0 and exact_dedup.ingest(docs, index, "b").where("kept").count() == 0
    index.close()


def removed_by_hand(rows):
    words = [(10**18 if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            run = tuple(w[k : k + 50])
            first[run] = min(i, first.get(run, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return bag(out)


def substring_rows(docs):
    table, cuts = substrings.remove_repeats(docs)
    found = {r.row: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in cuts.collect()}
    out = []
    for r in table.collect():
        n, sha = (r.n_words, hashlib.sha256(b"").hexdigest()) if r.whole else found.get(r.row, (0, bytes(r.digest).hex()))
        out.append((10**18 if r.doc_id is None else r.doc_id, r.n_words, n, sha))
    return bag(out)


def test_substring_dedup(docs, empty, rows):
    assert substring_rows(docs) == removed_by_hand(rows)
    assert substrings.remove_repeats(empty)[0].count() == 0


def test_rows_of_one_unit_are_searched_once(spark, monkeypatch):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    once = [(1, words(0, 60) + " one"), (5, words(0, 60) + " five " + words(100, 130)), (None, words(0, 55) + " none")]
    many = once[:1] + once[1:2] * 2000 + once[2:] * 2000
    staged, real = {}, substrings.stage

    def seen(df, name):
        staged[name] = real(df, name)
        return staged[name]

    monkeypatch.setattr(substrings, "stage", seen)
    sizes = []
    for rows in (once, many):
        assert substring_rows(spark.createDataFrame(rows, "doc_id long, text string")) == removed_by_hand(rows)
        sizes.append((staged["candidates"].count(), staged["windows"].count()))
    assert sizes[0] == sizes[1] and sizes[0][0] == 3


def test_source_mixing(docs, empty, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert bag((r.doc_id, r.size) for r in out) == bag((i, len(WORD.findall(t or ""))) for i, t in rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
    assert goal == pytest.approx(mixing.targets(dict(sizes)))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in goal:
        assert goal[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - goal[s]) <= 0.05 * sizes[s] + 2
    again = mixing.mix(docs.repartition(3)).collect()
    assert bag((r.doc_id, r.size, r.copies) for r in out) == bag((r.doc_id, r.size, r.copies) for r in again)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_repeated_rows_spread_over_blocks(spark, monkeypatch):
    rows = [(5, "the same four words", "a")] * 3000 + [(k, f"word {k}", "a") for k in range(500)] + [(5, "the same four words", None)] * 200
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BLOCK", 256)
    staged, real = {}, mixing.stage

    def seen(df, name):
        staged[name] = real(df, name)
        return staged[name]

    monkeypatch.setattr(mixing, "stage", seen)
    out = mixing.mix(table)
    assert max(r["count"] for r in staged["cube-0"].groupBy("rank", "block").count().collect()) < 512
    assert staged["cube-0"].groupBy("rank").agg(F.count_distinct("key"), F.count("*")).where("`count(DISTINCT key)` < `count(1)`").count() == 0
    again = mixing.mix(table.repartition(5))
    count = lambda x: bag((r.doc_id, r.source, r.copies) for r in x.collect())
    assert count(out) == count(again) and out.count() == len(rows)
    for source in ("a", None):
        of = [r for r in out.collect() if r.source == source]
        assert abs(sum(r.size * r.copies for r in of) - of[0].target) <= 8


def test_targets_by_hand():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200, "b": 500 / 3, None: 250 / 3})
    assert mixing.targets({"a": 0, "b": 10}) == pytest.approx({"a": 0, "b": 15})


def test_cube_keeps_totals():
    draw = np.random.default_rng(1)
    for _ in range(20):
        size, p = draw.integers(1, 500, 300).astype(float), np.full(300, 0.37)
        want = p @ size
        mixing._fly(p, size, draw)
        assert ((p > 0) & (p < 1)).sum() <= 2 and p @ size == pytest.approx(want) and p.sum() == pytest.approx(111)
        mixing._land(p, size, want)
        assert set(p) <= {0.0, 1.0} and abs(p @ size - want) <= 5


def test_every_source_lands(spark, monkeypatch):
    """A source of many blocks, small ones of one, each with a document as long as many others: all land near their targets."""
    monkeypatch.setattr(mixing, "BLOCK", 32)
    draw = np.random.default_rng(6)
    rows = [(s, 200 if k == 0 else int(draw.integers(1, 30))) for s, n in (("large", 300), *[(f"small{j}", 28) for j in range(8)], *[(f"middle{j}", 90) for j in range(4)]) for k in range(n)]
    table = spark.createDataFrame([(i, " ".join(["x"] * n), s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    for seed in (0, 1):
        out = mixing.mix(table, weights=(1,), share=0.5, seed=seed).collect()
        assert len(out) == len(rows)
        taken, goal, size = Counter(), {}, {}
        for r in out:
            taken[r.source] += r.size * r.copies
            goal[r.source], size[r.source] = r.target, r.source_size
        for s in goal:
            if goal[s] < size[s]:
                assert abs(taken[s] - goal[s]) <= 10, s


def fingerprints_by_hand(rows):
    out = []
    for i, t in rows:
        w = [x.encode().lower() for x in WORD.findall(t or "")]
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    return out


def components_by_hand(fps, most=2):
    out = {}
    for a in fps:
        if a in out:
            continue
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            new = {b for b in fps if b not in seen and (x ^ b).bit_count() <= most}
            seen |= new
            todo += new
        for b in seen:
            out[b] = min(seen)
    return out


def test_simhash(docs, empty, rows):
    found = simhash.near_groups(stage(simhash.fingerprints(docs.select("doc_id", "text"), lambda x: simhash.shingles(x, 3)), "fp"), 2).collect()
    want = fingerprints_by_hand(rows)
    assert bag((r.doc_id, r.fp % (1 << 64)) for r in found) == bag(want)
    root = components_by_hand({f for _, f in want})
    least = {}
    for i, f in want:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[r.fp % (1 << 64)]) for r in found)
    assert simhash.near_groups(stage(simhash.fingerprints(empty.select("doc_id", "text"), lambda x: simhash.shingles(x, 3)), "fp"), 2).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i and 100 <= i < 140]) == 1 and len([i for i in ids if i == 11 or (i and 200 <= i < 212)]) == 1 and len([i for i in ids if i and 300 <= i < 330]) == 30


@pytest.mark.parametrize(("most", "full"), [(2, 128), (2, 4), (6, 128), (6, 4)])
def test_links_connect_what_is_near(spark, monkeypatch, most, full):
    """Chains and clusters of fingerprints, with small and with full buckets, against all pairs."""
    monkeypatch.setattr(simhash, "FULL", full)
    draw = np.random.default_rng(most + full)
    fps = set()
    for _ in range(12):
        at = int(draw.integers(0, 1 << 63))
        for _ in range(int(draw.integers(1, 25))):
            fps.add(at)
            for b in draw.choice(64, int(draw.integers(1, most + 2)), replace=False):
                at ^= 1 << int(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = stage(spark.createDataFrame([(x,) for x in signed], "fp long"), "fps")
    got = simhash.components(simhash.links(table, most)).collect()
    root = {f: f for f in signed} | {r.a: r.b for r in got}
    want = components_by_hand(fps, most)
    groups = lambda key: sorted(sorted(v) for v in key.values())
    mine, theirs = defaultdict(list), defaultdict(list)
    for f in signed:
        mine[root[f]].append(f)
    for f in fps:
        theirs[want[f]].append(f - (1 << 64) if f >> 63 else f)
    assert groups(mine) == groups(theirs)


def near_groups_by_hand(texts):
    """Components of all pairs with 0.8 of their five-word shingles in common, each with its ids in order."""
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in sets}


def template_family(draw, n, length, slots):
    """Texts of one template in which some words vary, so that some pairs are similar and others, as near in words, aren't."""
    base = [f"w{int(draw.integers(400))}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in draw.choice(length, int(draw.integers(0, slots + 1)), replace=False):
            words[k] = f"v{int(draw.integers(6))}"
        out.append(" ".join(words))
    return out


def test_near_copies_in_full_buckets(spark):
    """Every pair that is similar enough counts, however many documents share a shingle."""
    draw = np.random.default_rng(3)
    texts = list(enumerate(t for length, slots in ((120, 8), (60, 5), (300, 16), (7, 2), (3, 1)) for t in template_family(draw, 40, length, slots)))
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.drop_near_copies(table).collect()} == near_groups_by_hand(texts)


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    """Near copies whose fingerprints are within two bits are linked by these; texts of one fingerprint that are unlike in five-word shingles aren't."""
    draw = np.random.default_rng(12)
    texts = []
    for _ in range(12):
        base = [f"w{int(k)}" for k in draw.integers(5000, size=400)]
        texts += [base, [*base, "end"], [*base[:-1], "other"], [*base[1:], "end"]]
    loop = "a b c d".split() * 40
    texts += [loop, [*loop, *"x y z u v w q r s t".split()], "one two three".split(), "one two three four".split(), []]
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    bits = {k: simhash.fingerprint(simhash.shingles(t.encode(), 3)) for k, t in rows}
    sets = {k: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for k, x in enumerate(texts)}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {(a, b) for a, b in combinations(range(len(rows)), 2) if bin(bits[a] ^ bits[b]).count("1") <= 2 and alike(a, b)}
    seen = []
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda sets, texts, known: seen.append({(r.a, r.b) for r in known.collect()}) or real(sets, texts, known))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert seen and len(seen[0]) >= 12 and seen[0] <= want
    assert any(bits[a] != bits[b] for a, b in seen[0])
    assert kept == near_groups_by_hand(rows)


def test_hot_shingles_are_dealt_to_groups(spark, monkeypatch):
    """With shingles hot that are in two documents, groups of few rows have heads of their own and give the same."""
    monkeypatch.setattr(simhash, "OFTEN", 2)
    monkeypatch.setattr(simhash, "HOT", 2)
    monkeypatch.setattr(simhash, "HEADS", 2)
    draw = np.random.default_rng(8)
    texts = list(enumerate(t for length, slots in ((120, 8), (60, 5), (7, 2), (900, 60)) for t in template_family(draw, 40, length, slots)))
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.drop_near_copies(table).collect()} == near_groups_by_hand(texts)


def test_parities_bound_what_differs(spark):
    draw = np.random.default_rng(9)
    rows = []
    for n, m in ((1, 1), (60, 64), (60, 70), (500, 520), (500, 620), (1024, 1025)):
        both = draw.integers(0, 1 << 63, max(n, m)).astype(np.uint64)
        x, y = both[:n], np.unique(np.concatenate([both[: m - m // 10], draw.integers(0, 1 << 63, m // 10).astype(np.uint64)]))
        rows.append((simhash._parities(x).view(np.int64).tolist(), simhash._parities(y).view(np.int64).tolist(), len(set(x.tolist()) ^ set(y.tolist()))))
    table = spark.createDataFrame(rows, "x array<long>, y array<long>, unlike int")
    found = table.select(simhash._at_least_unlike(simhash.F.col("x"), simhash.F.col("y")).alias("k"), "unlike").collect()
    assert all(0 <= r.k <= r.unlike and (r.unlike - r.k) % 2 == 0 for r in found) and sum(r.k for r in found) > 0.5 * sum(r.unlike for r in found)


def test_near_copies_of_sf01_are_found(spark):
    """Of the pairs of documents divisible by 50 with any other that are 0.8 similar, by brute force, all are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select(simhash.F.col("doc_id").alias("row"), simhash.F.encode("text", "UTF-8").alias("text"))
    texts = stage(docs, "texts")
    root = {r.a: r.b for r in simhash.near_classes(texts).collect()}
    sets, where = {}, defaultdict(list)
    for r in texts.collect():
        w = bytes(r.text).lower().split()
        sets[r.row] = {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))}
        for g in sets[r.row]:
            where[g].append(r.row)
    pairs = 0
    for q in (q for q in sets if q % 50 == 0):
        shared = Counter(i for g in sets[q] for i in where[g] if i != q)
        for i, n in shared.items():
            if n >= 0.8 * (len(sets[q]) + len(sets[i]) - n):
                pairs += 1
                assert root.get(q, q) == root.get(i, i), (q, i)
    assert pairs > 20


def test_near_copies_of_one_set_of_words(spark):
    """The first document of a set of words may be unlike the others, which are still compared with each other and with those of other sets."""
    draw = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    mixed = [str(x) for x in draw.permutation(words)]
    texts = [(0, " ".join(mixed)), (1, " ".join(words)), (2, " ".join([*words, "w7"])), (3, " ".join([*mixed[30:], *mixed[:30]])), (4, " ".join([*words, "other"])), (5, " ".join([*mixed[31:], *mixed[:30], "other", mixed[30]]))]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()}
    assert kept == near_groups_by_hand(texts) == {0, 1}


def test_pieces_with_white_space_inside_are_encoded_together(monkeypatch):
    """Ids are those of whole texts, and new words take few calls even where lines break inside them."""
    path, asked = vocabulary_path(), []
    real = load(path)

    class Counting:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(real, name)

    monkeypatch.setattr("tracelab.llm.tokenizer.load", lambda path: Counting())
    pieces = [f"end{k}.\nNext{k}" for k in range(300)] + ["\n\nx", "a\tb", "tail\n", "", " y"]
    found = encode_pieces(path, pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in real.encode_batch([" " + x for x in pieces], add_special_tokens=False)]
    assert len(asked) < 10
    texts = [" ".join(pieces[:40]), "a  b\n c\r\nd \n\n e", "", " ", "x\u0085 y\u00a0z"]
    whole = [e.ids for e in real.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing._document_ids(path, texts)] == whole


def test_frequent_shingles_only_order_the_prefixes(spark, monkeypatch):
    draw = np.random.default_rng(4)
    texts = list(enumerate(t for length, slots in ((120, 8), (60, 5)) for t in template_family(draw, 40, length, slots)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for sample, many in ((10_000, 0), (10, 50), (10_000, 50_000)):
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        monkeypatch.setattr(simhash, "FREQUENT", many)
        assert {r.doc_id for r in simhash.drop_near_copies(table).collect()} == near_groups_by_hand(texts)


def test_allocation_meets_the_pigeonhole():
    together = np.full((64, 64), 250.0)
    np.fill_diagonal(together, 500)
    for n, most in ((1000, 2), (1000, 6), (10**9, 2), (10**9, 3)):
        parts = simhash.allocate(together * (n / 1000), n, most)
        bits = [b for bits, _ in parts for b in bits]
        assert len(bits) == len(set(bits))
        assert sum(t + 1 for _, t in parts) >= most + 1


def test_packing(docs, empty, rows):
    tokenizer = load(vocabulary_path())
    out = packing.pack(docs).collect()
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_row[r.row].append(r)
        by_seq[r.sequence_id].append(r)
    want = Counter()
    for i, t in rows:
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids[: (len(ids) - 1) % 2048 + 1].tobytes())] += 1
    got = Counter()
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces][:-1]])) and all(r.length == 2048 for r in pieces[1:])
        got[pieces[0].doc_id, sum(r.length for r in pieces), pieces[0].ids_crc32] += 1
    assert got == want
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces][:-1]])) and sum(r.length for r in pieces) <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in out) // 2048) + 2
    assert packing.pack(empty).count() == 0


def test_plan_uses_every_piece_once():
    draw = np.random.default_rng(0)
    for hot in (0, 5000):
        counts = Counter(draw.integers(1, 2049, 3000).tolist())
        counts[700] += hot
        used = Counter()
        for lengths, times in packing.plan(counts, 2048):
            assert sum(lengths) <= 2048
            for n in lengths:
                used[n] += times
        assert used == counts
    exact = packing.plan({1000: 7, 1048: 7, 2048: 2, 500: 3, 548: 3}, 2048)
    assert sum(t for _, t in exact) == 11


def test_language(spark, docs, empty):
    rows = [(i, "der die das und nicht ist ein haus wird", "de") for i in range(40)] + [(100 + i, "the and of is a house which will not", "en") for i in range(40)] + [(200 + i, "le la les et est une maison qui ne sera pas", "fr") for i in range(40)] + [(300 + i, "el la los y es una casa que no será", "es") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.within) == {"germanic", "romance"}
    assert [model.predict(t)[0] for t in ("das ist nicht ein haus", "a house of the and", "une maison et la", "una casa y los")] == ["de", "en", "fr", "es"]
    out = language.predict(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(language.predict(empty, model).count() == 0 for _ in "1")
    nothing = language.train(empty)
    assert nothing.predict("text") == ("und", 0.0) and model.predict(None) == ("und", 0.0) and model.predict("12 !!") == ("und", 0.0)


def test_language_learns_the_same_from_repeated_ids(spark):
    rows = [(k % 20, f"{x} {k}", lang) for k in range(60) for lang, x in (("en", "the house and the sea"), ("de", "das Haus und das Meer"))]
    models = [language.train(spark.createDataFrame(rows[::step], "doc_id long, text string, lang string").repartition(n)) for step, n in ((1, 1), (-1, 4))]
    texts = spark.createDataFrame([(k, t, None) for k, (_, t, _) in enumerate(rows)], "doc_id long, text string, lang string")
    first, second = (sorted(map(tuple, language.predict(texts, m).collect())) for m in models)
    assert first == second


def test_language_held_out_accuracy(spark):
    out = language.op8_language_id(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = out.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(7, 1), (8, 1), (300, 1), (301, 0), (None, 1)], "doc_id long, quality int")
    ratios = quality.log_ratios(docs, labels.where("quality = 1"))
    out = quality.scored(docs.select("doc_id", "text"), ratios).collect()
    for r in out:
        assert r.log_weight == pytest.approx(float(ratios[quality._buckets(r.text or "")].sum()))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 0.8 * docs.count()
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).count() == docs.count()


def test_quality_against_brute_force(spark):
    """Models, weights, noise and the sample again, from the texts alone and without the operator's helpers."""
    draw = np.random.default_rng(11)
    good = lambda: " ".join(draw.choice(["The", "river", "runs", "to", "the", "sea", "and", "rests,"], 40))
    bad = lambda: " ".join(draw.choice(["BUY", "now!!!", "click", "here", "$$$", "free"], 40))
    texts = {k: good() if k % 3 else bad() for k in range(150)} | {150: "", 151: None, 152: "Ünïcode 漢字 ... x_y"}
    labels = {k: int(k % 3 > 0) for k in range(0, 150, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")

    def grams(text):
        ids = [zlib.crc32(x.lower().encode()) for x in re.findall(r"\w+|[^\w\s]+", text or "")]
        mixed = [x * 2246822519 for x in ids] + [a * 2654435761 + b * 40503 + 1 for a, b in zip(ids, ids[1:], strict=False)]
        return Counter((x % 2**32) >> 19 for x in mixed)

    bags = {k: grams(t) for k, t in texts.items()}
    raw, target = Counter(), Counter()
    for k, b in bags.items():
        raw += b
        if labels.get(k):
            target += b
    total, n = sum(raw.values()) + 8192, sum(target.values())
    p = lambda b: (raw[b] + 1) / total
    weight = {k: sum(c * np.log((target[b] + 2**18 * p(b)) / (n + 2**18) / p(b)) for b, c in bag_.items()) for k, bag_ in bags.items()}
    noise = {r.doc_id: (r.h % 2**40 + 0.5) / 2**40 for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("h")).collect()}
    key = {k: w - np.log(-np.log(noise[k])) for k, w in weight.items()}
    share = np.mean(list(labels.values()))
    k = int(np.ceil(len(texts) * (share + 0.1 * (1 - share))))
    want = set(sorted(key, key=key.get, reverse=True)[:k])
    rows = quality.scored(docs, quality.log_ratios(docs, marks.where("quality = 1"))).collect()
    assert {r.doc_id: r.log_weight for r in rows} == pytest.approx(weight, abs=1e-9)
    assert {r.doc_id: r.key for r in rows} == pytest.approx(key, abs=1e-9)
    assert {r.doc_id for r in quality.keep_good(docs, marks).collect()} == want


def test_kth_largest(spark):
    draw = np.random.default_rng(3)
    values = [*draw.normal(0, 1, 500).tolist(), *[2.5] * 100, -1e9, 1e9]
    table = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 50, 101, 300, len(values) - 1):
        assert quality.kth_largest(table, k, bins=7) == sorted(values, reverse=True)[k - 1]


def test_quality_rejects_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op2_quality_resampling(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert share.get((1, True), 0) >= 0.97 * sum(v for (q, _), v in share.items() if q == 1)
    assert share.get((0, False), 0) >= 0.8 * sum(v for (q, _), v in share.items() if q == 0)


def test_media_round_trip(docs, empty, rows):
    out = media.read_payloads(media.sniff_media(media.store_payloads(docs), "media", "declared_type")).collect()
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert bag((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert media.store_payloads(empty).count() == 0


def test_sniffing(spark):
    png = media.to_png(b"\x00\xff" * 576)
    wav = b"RIFF" + (36 + 4).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes(16) + b"data" + (4).to_bytes(4, "little") + bytes(4)
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(8) + b"\x00\x02\x01\x44\x00\x3b"
    cases = [("a", None), ("b", b""), ("c", png), ("d", b"text " + png + b"RIFF junk BM" + wav), ("e", b"\x89PNG\r\n\x1a\nbroken"), ("f", gif + png[:-3]), ("g", b"BM")]
    table = spark.createDataFrame([(k, bytearray(v) if v is not None else None, "image/png", 9) for k, v in cases], "k string, media binary, declared string, offset int")
    out = {r.k: r for r in media.sniff_media(table, "media", "declared").collect()}
    assert out["a"].actual_type is None and out["b"].actual_type == media.UNKNOWN and out["b"].length == 0
    assert (out["c"].actual_type, out["c"].length, out["c"].mistyped) == ("image/png", len(png), False)
    assert [(x.type, x.offset, x.length) for x in out["d"].embedded] == [("image/png", 5, len(png)), ("audio/wav", 5 + len(png) + 12, len(wav))]
    assert out["e"].actual_type == media.UNKNOWN and out["e"].mistyped and (out["f"].actual_type, out["f"].length, out["f"].embedded) == ("image/gif", len(gif), []) and out["g"].actual_type == media.UNKNOWN


def test_entries_that_fit_no_other_are_not_met_again(spark, monkeypatch):
    counts, real = {}, simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name: counts.update({name: counts.get(name, 0) + (out := real(df, name)).count()}) or out)
    words = ["".join(chr(97 + (k * 7 + j * j) % 26) for j in range(3 + k % 5)) + str(k) for k in range(600)]
    # Of the first three, which share shingle 7, none is near another's size; the next three share 8 and are of one size.
    sizes = [10, 30, 90, 20, 20, 20]
    texts = real(spark.createDataFrame([(k, " ".join(words[k * 100 : k * 100 + n + 4]).encode()) for k, n in enumerate(sizes)], "row long, text binary"), "texts")
    sets = real(spark.createDataFrame([(k, n, [0], [7 if k < 3 else 8], []) for k, n in enumerate(sizes)], "row long, n int, bits array<long>, firsts array<long>, hots array<int>"), "sets")
    found = simhash.near_links(sets, texts, real(spark.createDataFrame([], "a long, b long"), "known"))
    assert found.count() == 0
    assert counts["shared-shingles"] == 3 and counts["near-roots"] == 2


def test_partners_of_entries_are_never_missed(spark):
    draw = random.Random(5)
    rows = [(k, draw.randrange(60), n := draw.randrange(1, 200), draw.randrange(n // 5 + 1), draw.random() < 0.8) for k in range(400)]
    table = spark.createDataFrame([(k, g, (n << 32) + pos * 2, among) for k, g, n, pos, among in rows], "row long, g long, rest long, among boolean")
    found = {r.row: r.partner for r in simhash._with_partner(table, Window.partitionBy("g"), F.col("among"), "partner").collect()}
    fits = lambda a, b: 9 * min(a[2] - a[3], b[2] - b[3]) >= 4 * (a[2] + b[2])
    have = {a[0] for a in rows if a[4] and any(b[0] != a[0] and b[1] == a[1] and b[4] and fits(a, b) for b in rows)}
    assert have <= {k for k, partner in found.items() if partner} and not all(found.values())
