"""Each stage of the pipeline on documents with odd cases and on none, against brute force, each on what the one before kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.fixtures import SCHEMA, documents
from tests.llm.test_documents import WORD, near_groups_by_hand
from tracelab.llm import mixing
from tracelab.llm.tokenizer import load, vocabulary_path


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with labels that are all good, so that all documents are sampled, and with a null id and label."""
    at = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(7, 1, 0), (8, 1, 0), (300, 1, 0), (None, 1, None), (9, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def staged(spark, sf, docs, k):
    return corpus_pipeline.stage(corpus_pipeline.STAGES[k][1](spark, docs, sf), "test")


def test_stages_against_brute_force(spark, sf):
    docs = spark.createDataFrame(documents(), SCHEMA)
    full = lambda x: Counter(map(tuple, x.collect()))
    good = staged(spark, sf, docs, 0)
    assert good.columns == docs.columns and full(good) == full(docs)

    exact = staged(spark, sf, good, 1)
    least = {}
    for r in good.collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[text] = min(least.get(text, 10**18), 10**18 if r.doc_id is None else r.doc_id)
    kept = exact.collect()
    assert exact.columns == docs.columns and not full(exact) - full(good)
    assert Counter((re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), 10**18 if r.doc_id is None else r.doc_id) for r in kept) == Counter(least.items())

    near = staged(spark, sf, exact, 2)
    texts = [(10**18 if r.doc_id is None else r.doc_id, r.text or "") for r in kept]
    assert near.columns == docs.columns and not full(near) - full(exact)
    assert {10**18 if r.doc_id is None else r.doc_id for r in near.collect()} == near_groups_by_hand(texts)

    mixed = staged(spark, sf, near, 3)
    words, taken = defaultdict(list), Counter()
    for r in near.collect():
        words[r.source].append(len(WORD.findall(r.text or "")))
    sizes = {s: sum(n) for s, n in words.items()}
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
    goal = mixing.targets(sizes)
    often = full(mixed)
    assert mixed.columns == docs.columns and set(often) <= set(full(near)) and max(often.values()) <= 2
    for source, want in goal.items():
        extra = {0}  # words that a sample of the source's documents can have; a long document may leave none near the target
        for n in words[source]:
            extra |= {x + n for x in extra}
        sure = int(want / sizes[source] + 1e-9) * sizes[source]
        assert abs(taken[source] - want) <= min(abs(sure + x - want) for x in extra) + 0.05 * sizes[source] + 2

    out = staged(spark, sf, mixed, 4).collect()
    tokenizer, want = load(vocabulary_path()), Counter()
    for r in mixed.collect():
        ids = np.asarray([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((r.doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())) for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == list(np.cumsum([0, *[n for _, n in places][:-1]])) and sum(n for _, n in places) <= 2048


def test_stages_of_nothing(spark, sf):
    seen = spark.createDataFrame([], SCHEMA)
    for k in range(5):
        seen = staged(spark, sf, seen, k)
        assert seen.count() == 0
