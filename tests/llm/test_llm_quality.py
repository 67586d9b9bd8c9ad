from __future__ import annotations

import random

import awkward
import numpy as np
import pyarrow as pa
import pytest

from hashgrove.llm import quality, vec


def good(rng):
    return "\n".join(" ".join(awkward.sentence(rng, rng.randint(5, 12)) for _ in range(3)) for _ in range(rng.randint(2, 6)))


def bad(rng):
    how = rng.randrange(3)
    words = [rng.choice(awkward.WORDS) for _ in range(rng.randint(40, 120))]
    if how == 0:
        return " | ".join(words)
    return " ".join(w.upper() + "!!" for w in words) if how == 1 else " ".join(w for w in words[:9] for _ in range(12))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    return [(i, (good if i % 10 < 7 else bad)(rng), i % 10 < 7) for i in range(900)]


@pytest.fixture(scope="module")
def network(spark, corpus):
    docs = spark.createDataFrame([r[:2] for r in corpus], "doc_id bigint, text string")
    trusted = spark.createDataFrame([(i,) for i, _, y in corpus if y and i % 3 == 0], "doc_id bigint")
    return quality.fit(docs, trusted)


def test_held_out_documents(spark, corpus, network):
    docs = spark.createDataFrame([r[:2] for r in corpus], "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, network).collect()}
    assert 0.6 <= network.prior <= 0.8
    held = [(found[i], y) for i, _, y in corpus if i % 3]
    assert np.mean([(s >= 0.5) == y for s, y in held]) >= 0.98


def test_training_repeats(corpus):
    arrays = vec.buffers(pa.array([t for _, t, _ in corpus]))
    x = quality.features(*arrays)
    y = np.array([y for *_, y in corpus])
    a, b = (quality.train(x[y][::3], x, 0.7, steps=50) for _ in range(2))
    assert (a.scores(x) == b.scores(x)).all()


def test_the_prior_is_estimated():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(2, 1, 4000), rng.normal(-2, 1, 2000)
    mixed = np.concatenate([rng.normal(2, 1, 3000), negative])
    shares = np.array([(mixed >= c).mean() for c in quality.tails(positive)])
    assert abs(quality.estimate_prior(positive, shares) - 0.6) < 0.05


def test_tail_shares_are_of_all_documents(spark, corpus, network):
    rows = [r[:2] for r in corpus] + [corpus[0][:2]] * 50 + [(None, "x")]
    named = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    outputs = network.outputs(quality.features(*vec.buffers(pa.array([t for _, t, _ in corpus]))))
    cuts = np.quantile(outputs, [0.0, 0.2, 0.2, 0.9])
    found = quality.tail_shares(named.where("id is not null"), network, cuts)
    assert np.allclose(found, [(outputs >= c).mean() for c in cuts])
    assert quality.tail_shares(named.limit(0), network, cuts).tolist() == [0.0] * 4


def test_features_are_those_of_each_text_alone():
    texts = ["A line. Another one, here!\nA line. Another one, here!", "", "x | y | z", "WORD WORD WORD", None, "é漢😀 x́", " \n\n "]
    together = quality.features(*vec.buffers(pa.array(texts)))
    for i, text in enumerate(texts):
        assert np.allclose(together[i], quality.features(*vec.buffers(pa.array([text], pa.string())))[0])
    named = dict(zip(quality.NAMES, together[0], strict=True))
    assert named["log_words"] == np.log1p(10) and named["lines_new"] == 0.5 and named["words_new"] == 0.5 and named["lines_unended"] == 1
    assert dict(zip(quality.NAMES, together[3], strict=True))["words_same_as_last"] == pytest.approx(2 / 3)
    assert (together[1] == 0).all() and (together[4] == 0).all()


def test_awkward_rows_and_empty_tables(spark, network):
    docs = awkward.frame(spark)
    found = quality.score(docs, network).collect()
    assert sorted(repr(r["doc_id"]) for r in found) == sorted(repr(r[0]) for r in awkward.rows())
    assert all(0 <= r["score"] <= 1 for r in found)
    few = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id bigint")
    assert quality.score(docs, quality.fit(docs, few)).count() == docs.count()
    assert quality.fit(awkward.empty(spark), few) is None and quality.fit(docs, few.limit(0)) is None
    assert quality.score(docs, None).first()["score"] == 0.5
    assert quality.score(awkward.empty(spark), network).count() == 0


def test_a_repeated_identifier_counts_once(spark, corpus):
    trusted = spark.createDataFrame([(i,) for i, _, y in corpus if y and i % 3 == 0], "doc_id bigint")
    once = [r[:2] for r in corpus]
    fitted = [quality.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), trusted, max_sample=400) for rows in (once, once + once[1:2] * 2000)]
    assert all(network is not None for network in fitted)
    x = quality.features(*vec.buffers(pa.array([t for _, t, _ in corpus])))
    assert np.allclose(fitted[0].scores(x), fitted[1].scores(x))
