"""Spelling variants against a plain computation over deletion variants, and the search schemes against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import awkward
import numpy as np
import pytest

from hashgrove.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether two different words are one edit apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, one_in=97, least=5):
    counts = Counter()
    for i, text in rows:
        for word in RUN.findall(text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def plain(counts, least=3, ratio=2):
    words = {w: n for w, n in counts.items() if n >= least}
    by_rest, close = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            by_rest[i, rest].add(w)
            if rest in words:
                close[w].add(rest)
                close[rest].add(w)
    for group in by_rest.values():
        for w in group:
            close[w] |= group - {w}
    form = {}
    for w in words:
        if close[w]:
            best = min(close[w], key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(close[w]), words[form[w]] if w in form else None))
    return out


def vocabulary(seed, letters="abé", n=160, lengths=(5, 9)):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_both_schemes_find_every_pair_once(seed):
    words = vocabulary(seed)
    half = np.array([len(w) // 2 for w in words])
    forward = spelling.search(spelling.Index(words), words, half)
    pairs = list(zip(*(x.tolist() for x in forward), strict=True))
    back = spelling.search(spelling.Index([w[::-1] for w in words]), [w[::-1] for w in words], np.array([len(w) for w in words]) - half)
    more = [(q, f) for q, f in zip(*(x.tolist() for x in back), strict=True) if not words[f].startswith(words[q][: len(words[q]) // 2])]
    assert len(pairs) == len(set(pairs)) and len(more) == len(set(more)) and not set(pairs) & set(more)
    assert set(pairs) | set(more) == {(q, f) for q, a in enumerate(words) for f, b in enumerate(words) if near(a, b)}


def test_symbols_that_no_word_has_and_words_like_one_another():
    index = spelling.Index(["aaaaa", "aaaaaa", "aaaab"])
    found = spelling.search(index, ["aaaax", "xxxxx", "aaaaa", "aaaaaaa"], np.array([2, 2, 2, 3]))
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == [(0, 0), (0, 2), (2, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("shard", [1, 7, 40, 10_000])
def test_shards_of_any_size_give_the_same(spark, shard):
    words = vocabulary(11, "ab", 220, (5, 8)) + ["x" * 300, "x" * 301, "x" * 302]
    counts = {w: 3 + i % 17 for i, w in enumerate(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = {tuple(r) for r in spelling.near_words(table, shard).collect()}
    expected = set()
    for w in words:
        close = [v for v in words if near(w, v)]
        if close:
            best = min(close, key=lambda v: (-counts[v], v))
            expected.add((w, len(close), counts[best], best))
    assert found == expected


def test_awkward_rows_and_ties(spark):
    rows = [(r[0], r[1]) for r in awkward.rows()]
    rng = random.Random(2)
    extra = [(100 + i, " ".join(w for w in vocabulary(3, "abÉ×ÿ", 60) for _ in range(rng.randint(1, 9)))) for i in range(6)]
    extra += [(200, "Winter WINTER winterr wintre wintér Ωωω" * 40), (None, "harbor harbour " * 30)]
    docs = spark.createDataFrame([(*r, 7, "x", 1, 1, 0.5, 3, "q", 0) for r in rows + extra], awkward.SCHEMA).repartition(3)
    for one_in in (97, 3):
        found = {tuple(r) for r in spelling.spelling_variants(docs, deleted_one_in=one_in, shard=50).collect()}
        assert found == plain(plain_counts(rows + extra, one_in))
    assert any(form != root and form for _, form, root, *_ in found)


def test_empty_tables(spark):
    assert spelling.spelling_variants(awkward.empty(spark)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "12 34"), (2, None)], "doc_id int, text string")).count() == 0


def test_roots_follow_long_ways(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(50)] + [("a", "w049"), ("b", "c")]
    found = {tuple(r) for r in spelling._roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {(w, "c" if w == "b" else "w050") for w, _ in chain}
