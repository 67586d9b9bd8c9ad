"""Exact quantiles against sorting, whatever the brackets say, and how many values are exchanged for them."""

from __future__ import annotations

import math
import random

import pytest

from hashgrove.operators import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]


def plain(values, shares):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    return [values[max(1, math.ceil(len(values) * p)) - 1] for p in shares]


def found(df, shares=SHARES):
    return {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, "g", "v", shares).collect()}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    made = [("big", rng.gauss(0, 1)) for _ in range(30_000)] + [("ties", float(rng.randint(0, 3))) for _ in range(5000)]
    made += [(None, rng.expovariate(1)) for _ in range(3000)] + [("one", 7.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    return spark.createDataFrame(made, "g string, v double").repartition(5).persist()


def grouped(df):
    out = {}
    for r in df.collect():
        if r["v"] is not None:
            out.setdefault(r["g"], []).append(r["v"])
    return out


def test_quantiles_are_exact(skewed):
    assert found(skewed) == {g: plain(values, SHARES) for g, values in grouped(skewed).items()}


@pytest.mark.parametrize("margin", [1e-9, 0.3, 1.0])
def test_brackets_that_miss_are_widened(skewed, monkeypatch, margin):
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    assert found(skewed) == {g: plain(values, SHARES) for g, values in grouped(skewed).items()}


def test_few_values_are_exchanged(skewed, monkeypatch):
    inside = []
    monkeypatch.setattr(quantiles, "_counted", lambda *a, f=quantiles._counted: (inside.append(f(*a)), inside[-1])[1])
    found(skewed.where("g = 'big'"), [0.25, 0.75])
    (counts,) = inside
    rows = counts.where("v is not null").agg({"n": "sum"}).first()[0]
    assert rows < 0.1 * 30_000 and counts.where("v is null").count() == 2


def test_not_a_number_comes_last(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", float("inf")), ("b", float("nan"))], "g string, v double")
    got = found(df, [0.3, 0.6, 1.0])
    assert got["a"][:2] == [1.0, math.inf] and math.isnan(got["a"][2]) and all(map(math.isnan, got["b"]))


def test_whole_numbers_beyond_the_precision_of_doubles(spark):
    values = [2**60 + i for i in range(300)] + [-(2**60) - i for i in range(300)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v bigint")
    assert found(df, [0.1, 0.5, 0.9])["a"] == [sorted(values)[k] for k in (59, 299, 539)]


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], "g string, v double")) == {}
    assert found(spark.createDataFrame([("a", None)], "g string, v double")) == {}
