from __future__ import annotations

import random
import re

import awkward
import numpy as np
import pytest

from hashgrove.llm import decontam


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute_tiles(item, doc, least):
    """Greedy string tiling by comparing every pair of places."""
    free_i, free_d, covered, tiles = [True] * len(item), [True] * len(doc), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered, tiles
        for k in range(n):
            free_i[i + k] = free_d[j + k] = False
        covered, tiles = covered + n, tiles + 1


def test_tiles_are_those_of_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randint(1, 4) for _ in range(rng.randint(0, 18))]
        doc = [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5 and len(item) > 6:
            doc[3:3] = item[4:] + item[:4]
        found = decontam.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert found == brute_tiles(item, doc, 3)


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(11)
    items = [(i, " ".join(awkward.sentence(rng, 10) for _ in range(4))) for i in range(8)] + [(8, "too short"), (9, None), (10, ""), (None, "x y z w v u")]
    return spark.createDataFrame(items, "item_id bigint, text string"), items


def test_pairs_are_those_of_brute_force(spark, benchmark):
    frame, items = benchmark
    rng = random.Random(12)
    rows = [(r[0], r[1]) for r in awkward.rows() if r[0] != 24]
    for i, text in items[:8]:
        parts = re.split(r"(?<=\.) ", text)
        rng.shuffle(parts)
        own = awkward.texts(seed=50 + i, n=2)
        rows += [(100 + i, own[0] + "\n" + text.upper() + own[1]), (200 + i, " And then ".join(parts)), (300 + i, own[0] + " ".join(parts[:1])), (400 + i, parts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {(r["doc_id"], r["item_id"]): (r["item_tokens"], r["covered_tokens"], r["tiles"]) for r in decontam.contaminated(docs, frame).collect()}
    expected = {}
    for d, text in rows:
        for i, item in items:
            words = tokens(item)
            if d is not None and i is not None and len(words) >= 5:
                covered, tiles = brute_tiles(words, tokens(text), 5)
                if covered >= 0.5 * len(words):
                    expected[d, i] = (len(words), covered, tiles)
    assert found == expected
    assert {(100, 0), (207, 7)} <= set(found) and (300, 0) not in found


def test_what_covers_an_item_has_one_of_its_rarest_seeds():
    rng = random.Random(7)
    covering = 0
    for _ in range(400):
        item = np.array([rng.randint(1, 5) for _ in range(rng.randint(3, 30))], np.uint64)
        seeds = decontam.vec.window_hashes(item, 3)
        documents = np.array([hash(int(h)) % 7 for h in seeds], np.int64)
        share = rng.choice([0.1, 0.5, 0.9, 1.0])
        kept = decontam.rarest(seeds, documents, len(item), share, 3)
        doc = np.array([rng.randint(1, 5) for _ in range(rng.randint(0, 30))], np.uint64)
        if rng.random() < 0.6:
            a, b = sorted(rng.sample(range(len(item) + 1), 2))
            doc = np.concatenate([doc[:5], item[a:b], doc[5:]])
        covered = decontam.tile(item, doc, 3)[0]
        assert decontam.coverable(seeds, doc, 3) >= covered
        if covered >= share * len(item):
            covering += 1
            assert set(kept.tolist()) & set(decontam.vec.window_hashes(doc, 3).tolist())
    assert covering > 50
    assert len(decontam.rarest(np.empty(0, np.uint64), np.empty(0, np.int64), 2, 0.5, 3)) == 0


def test_a_phrase_that_all_share_makes_no_candidates(spark):
    rng = random.Random(3)
    phrase = "twelve words that every single item and every document of them share"
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join([*(word() for _ in range(15)), phrase, *(word() for _ in range(15))])) for i in range(400)]
    docs = [(i, " ".join([*(word() for _ in range(30)), phrase, *(word() for _ in range(30))])) for i in range(400)] + [(900, items[5][1])]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = []
    pairs, own = [], decontam.candidates
    try:
        decontam.candidates = lambda *a: (pairs.append(own(*a)), pairs[-1])[1]
        found = [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontam.contaminated(*frames).collect()]
    finally:
        decontam.candidates = own
    assert found == [(900, 5, 1.0)] and pairs[0].count() == 1


def test_items_that_share_an_identifier_are_tiled_each(spark):
    rng = random.Random(5)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(2))
    items = spark.createDataFrame([(1, a), (1, b), (1, b)], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, a), (11, b), (12, "x " + b)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()) == [(10, 1), (11, 1), (12, 1)]


def test_a_full_table_changes_nothing(spark, benchmark, monkeypatch):
    frame, items = benchmark
    docs = spark.createDataFrame([(1, items[0][1]), (2, awkward.long_text())], "doc_id bigint, text string")
    monkeypatch.setattr(decontam, "_bit_table", lambda items: np.full(1 << decontam.TABLE_BITS - 3, 255, np.uint8))
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, frame).collect()] == [(1, 0)]


def test_removal_and_empty_tables(spark, benchmark):
    frame, items = benchmark
    docs = awkward.frame(spark)
    kept = decontam.remove_contaminated(docs, frame)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontam.contaminated(awkward.empty(spark), frame).count() == 0
    assert decontam.contaminated(docs, frame.limit(0)).count() == 0
