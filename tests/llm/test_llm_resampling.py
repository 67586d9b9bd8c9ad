"""Importance resampling against a plain computation, and CRC-32 of joined strings against zlib."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import awkward
import numpy as np
import pyarrow as pa
import pytest

from hashgrove.llm import crc, resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, target, percent=5, least=20):
    """Rows (id, n_features, weight, score) and the drawn scores in order."""

    def features(text):
        words = WORD.findall((text or "").encode().lower())
        return [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)

    found = [(i, *features(t)) for i, t in rows]
    s, t = (Counter(b for f in side for b in f) for side in ([f for _, f, _ in found], [features(x)[0] for x in target]))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (all_s + 10_000)) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out, pool = [], []
    for i, f, n in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
        if n >= least:
            pool.append(out[-1])
    pool.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    return out, pool[: percent * len(pool) // 100]


def test_crc_of_joined_strings():
    rng = random.Random(3)
    parts = [rng.randbytes(n) for n in [0, 1, 2, 63, 64, 65, 127, 128, 1000, 4096, 70_000] + [rng.randint(0, 40) for _ in range(200)]]
    pairs = [(rng.choice(parts), more) for more in parts]
    checks = [np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1)]
    found = crc.append(*checks, np.array([len(b) for _, b in pairs]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_words_and_their_bounds():
    texts = pa.array(["One two,one", None, "", " ,", "a", "  É É9x "]).slice(0)
    different, found, bounds = crc.words(texts, resampling.SEPARATORS)
    assert [different[i].as_py() for i in found.tolist()] == ["one", "two", "one", "a", "É", "É9x"]
    assert bounds.tolist() == [0, 3, 3, 3, 3, 4, 6]


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_awkward_rows(spark, percent):
    rows = [(r[0], r[1]) for r in awkward.rows()]
    target = [*awkward.texts(seed=4, n=3), None, "", "Und!"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    found = resampling.resample(awkward.frame(spark), items, percent=percent).collect()
    expected, drawn = plain(rows, target, percent)
    assert sorted(map(repr, (tuple(r)[:4] for r in found))) == sorted(map(repr, expected))
    picked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in picked] == list(range(1, len(drawn) + 1))
    assert [tuple(r)[:4] for r in picked] == drawn


def test_a_repeated_identifier_is_drawn_row_by_row(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(7, text)] * 400 + [(8, "short")], "doc_id int, text string").repartition(6)
    found = resampling.resample(docs, spark.createDataFrame([("w1 w2",)], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 201))
    assert [r["rank"] for r in found if r["doc_id"] == 8] == [None]


def test_no_target_and_no_documents(spark):
    nothing = spark.createDataFrame([], "item_id int, text string")
    found = resampling.resample(awkward.frame(spark), nothing).collect()
    expected, _ = plain([(r[0], r[1]) for r in awkward.rows()], [])
    assert sorted(map(repr, (tuple(r)[:4] for r in found))) == sorted(map(repr, expected))
    assert resampling.resample(awkward.empty(spark), nothing).count() == 0


def test_texts_longer_than_a_piece(spark):
    rows = [(i, awkward.long_text(300_000 + i)) for i in range(2)] + [(9, "tail end " * 12)]
    found = resampling.resample(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([("river stone garden",)], "text string")).collect()
    assert sorted(tuple(r)[:4] for r in found) == sorted(plain(rows, ["river stone garden"])[0])
