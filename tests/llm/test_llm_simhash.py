from __future__ import annotations

import random

import awkward
import pytest
import xxhash

from hashgrove.llm import simhash
from hashgrove.llm.components import components


def fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, linked):
    """Smallest member of each point's component, by flooding."""
    least = {}
    for p in sorted(points):
        if p in least:
            continue
        stack = [p]
        while stack:
            q = stack.pop()
            if q not in least:
                least[q] = p
                stack += [r for r in points if r not in least and linked(q, r)]
    return least


def test_fingerprints_and_components_of_awkward_rows(spark):
    rows = awkward.rows()
    found = simhash.near_duplicates(awkward.frame(spark)).collect()
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    prints = [(r[0], signed(fingerprint(r[1]))) for r in rows]
    assert sorted((repr(r["doc_id"]), r["fingerprint"]) for r in found) == sorted((repr(i), f) for i, f in prints)
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    groups = {}
    for i, f in prints:
        groups.setdefault(f, []).append(i)
    least = classes(groups, lambda a, b: distance(a, b) <= 2)
    names = {}
    for f, first in least.items():
        names.setdefault(first, []).extend(i for i in groups[f] if i is not None)
    for r in found:
        members = names[least[r["fingerprint"]]]
        assert r["component"] == (min(members) if members else None)


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_no_link_is_lost(spark, distance):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for f in list(prints):
        for flips in (1, 2, 3):
            for bit in rng.sample(range(64), flips):
                f ^= 1 << bit
            prints.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    table = spark.createDataFrame([(f,) for f in signed], "fingerprint bigint")
    found = {(r["x"], r["y"]) for r in simhash.close_pairs(table, distance=distance).collect()}
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert found == expected


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(8, 40)] + [(50, 51), (51, 52), (52, 50)] + [(3, 3), (None, 4), (51, 50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(7, 40), 7), **dict.fromkeys((50, 51, 52), 50)}


def test_one_of_each_group_stays(spark):
    docs = awkward.frame(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in found if i is not None) == sorted({i for i, c in groups.items() if i == c})
    assert found.count(None) == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(awkward.empty(spark)).count() == 0
    assert simhash.keep_first(awkward.empty(spark)).count() == 0


def test_the_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(4, 900))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            rows.append((len(rows), " ".join(copy)))
    prints = {i: fingerprint(t) for i, t in rows}
    first = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r["doc_id"] for r in found.collect()} == set(first.values())
    assert any(prints[i] != prints[first[i]] for i in first)
