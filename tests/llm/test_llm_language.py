"""The byte network: held-out accuracy, its arithmetic against plain loops, and rows that are hard to take."""

from __future__ import annotations

import random

import awkward
import numpy as np
import pytest

from hashgrove.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def network(seed=1, names=("de", "en", "fr")):
    rng = np.random.default_rng(seed)
    n = language.FILTERS * len(language.WIDTHS)
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    return language.Network(list(names), draw(256, language.VECTOR), draw(language.WIDEST * language.VECTOR, n) * language._OPEN, draw(n), draw(n, len(names)) / 8, draw(len(names)))


def plain(net, raw):
    """Probabilities of one text, filter by filter and place by place."""
    total, size = np.zeros(len(net.languages)), len(raw)
    for first in range(0, size, language.LENGTH):
        seen = [net.vectors[b] for b in raw[first : first + language.ROW]] + [net.vectors[0]] * language.ROW
        top = []
        for f in range(net.filters.shape[1]):
            width = language.WIDTHS[f // language.FILTERS]
            weights = net.filters[: width * language.VECTOR, f]
            top.append(max(float(np.concatenate(seen[i : i + width]) @ weights) for i in range(language.LENGTH)))
        z = np.maximum(np.array(top) + net.lift, 0) @ net.out + net.out_lift
        p = np.exp(z - z.max())
        total += p / p.sum() * min(language.LENGTH, size - first)
    return total / max(1, size)


@pytest.mark.parametrize("size", [1, 3, 4, 5, 255, 256, 257, 260, 700])
def test_probabilities_of_whole_texts(size):
    net, rng = network(), random.Random(size)
    texts = [rng.randbytes(n) for n in (size, 2, 0, size + 1)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = net.documents(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for row, text in zip(found, texts, strict=True):
        assert np.allclose(row, plain(net, text), atol=1e-4)


def test_windows_at_once_do_not_matter(monkeypatch):
    net, raw = network(2), random.Random(5).randbytes(9 * language.LENGTH + 17)
    offsets = np.array([0, 300, 300, len(raw)])
    whole = net.documents(np.frombuffer(raw, np.uint8), offsets)
    monkeypatch.setattr(language, "AT_ONCE", 2)
    assert np.allclose(net.documents(np.frombuffer(raw, np.uint8), offsets), whole, atol=1e-6)


def test_held_out_accuracy(spark):
    found = queries.op12_language(spark, FOLDER).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(found) == len(truth) and all(0 <= r["score"] <= 1 for r in found)
    held = [truth[r["doc_id"]] == r["lang_pred"] for r in found if r["held_out"] and truth[r["doc_id"]]]
    assert len(held) > 150 and sum(held) >= 0.97 * len(held)


def test_awkward_rows(spark):
    docs = awkward.frame(spark)
    found = {}
    for r in language.identify(docs, network()).collect():
        found.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert sum(map(len, found.values())) == len(awkward.rows())
    assert [found[i] for i in (20, 21, 22)] == [[("und", 0.0)]] * 3
    assert all(name in ("de", "en", "fr") and 0 < p <= 1 for i in (23, 24, 25, 26) for name, p in found[i])
    assert language.identify(awkward.empty(spark), network()).count() == 0


def test_texts_without_letters_and_without_a_network(spark):
    docs = spark.createDataFrame([(1, "12 34 -", "en"), (2, "漢字", "ja"), (3, None, "en"), (None, "abc", "en"), (4, "abc", None)], "doc_id int, text string, lang string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in language.identify(docs, None).collect()}
    assert set(rows.values()) == {("und", 0.0)}
    assert language.identify(docs, network()).where("doc_id = 1").first()["lang_pred"] == "und"
    assert language.fit(docs).languages == ["ja"]
    assert language.fit(docs.where("doc_id = 4")) is None
    assert language.fit(docs.limit(0)) is None


def test_the_sample_is_bounded_and_takes_rare_languages(spark):
    rows = [(7, "hot text " * 5 + str(i), "en") for i in range(3000)] + [(100 + i, f"some text {i}", "en") for i in range(300)]
    rows += [(1000 + i, f"un texte {i}", "fr") for i in range(5)]
    docs = spark.createDataFrame(rows, "id int, text string, lang string")
    found = language._sample(docs, 40).collect()
    assert len(found) == len(set(found)) <= 40
    counts = {name: sum(r["lang"] == name for r in found) for name in ("en", "fr")}
    assert counts == {"en": 20, "fr": 5}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(4)], "doc_id int, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.fit(docs)
