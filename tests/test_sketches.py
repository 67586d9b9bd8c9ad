"""Count-min sketches against exact counts, merged and cut in any way; the rest of a group against its rows."""

from __future__ import annotations

import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashgrove.operators import groups, sketches
from helpers import rows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(4)
    made = []
    for i in range(30_000):
        value = f"hot{rng.randrange(30)}" if rng.random() < 0.4 else f"cold{rng.randrange(9000)}"
        made.append((rng.choice(["a", "b", None]), None if i % 100 == 0 else value, f"x{i % 7}"))
    return spark.createDataFrame(made, "k string, v string, w string").repartition(6).persist()


def exact(df, column="v"):
    return Counter((r["k"], r[column]) for r in df.collect() if r[column] is not None)


def test_the_shape_follows_from_the_parameters():
    shape = sketches.Shape()
    assert (shape.width, shape.depth) == (2719, 24)
    buckets = shape.buckets(np.arange(-50_000, 50_000))
    assert buckets.shape == (24, 100_000) and buckets.min() >= 0 and buckets.max() < 2719
    # each row spreads values evenly, and in its own way
    assert all(np.bincount(row, minlength=2719).max() < 90 for row in buckets)
    assert np.mean(buckets[0] == buckets[1]) < 0.002
    assert not np.array_equal(buckets, sketches.Shape(seed=2).buckets(np.arange(-50_000, 50_000)))


def test_no_count_is_missed_and_none_is_far_too_high(spark, skewed):
    sketch = sketches.summarise(skewed, {"k": F.col("k")}, {"v": F.col("v"), "w": F.col("w")})
    counts = exact(skewed)
    total = Counter()
    for (k, _), n in counts.items():
        total[k] += n
    assert len({v for _, v in counts}) > 5000
    assert {(r["k"], r["category"]): r["total"] for r in sketches.totals(sketch).collect() if r["category"] == "v"} == {(k, "v"): n for k, n in total.items()}
    asked = spark.createDataFrame([(k, "v", v) for k, v in counts] + [("a", "v", "never"), ("z", "v", "hot1")], "k string, category string, value string")
    found = {(r["k"], r["value"]): r["n"] for r in sketches.estimates(sketch, asked).collect()}
    assert len(found) == len(counts) + 2
    for place, n in found.items():
        assert counts[place] <= n <= counts[place] + sketches.EPS * total[place[0]]
    assert found["z", "hot1"] == 0


def test_heavy_hitters(skewed):
    sketch = sketches.summarise(skewed, {"k": F.col("k")}, {"v": F.col("v")})
    counts = exact(skewed)
    found = {}
    for r in sketches.heavy_hitters(sketch, 30).collect():
        found.setdefault(r["k"], set()).add(r["value"])
    for k in ("a", "b", None):
        assert found[k] == {f"hot{i}" for i in range(30)}
    exact_n = {(r["k"], r["value"]): r["n"] for r in sketches.heavy_hitters(sketch, 30).collect()}
    assert all(0 <= n - counts[p] <= 10 for p, n in exact_n.items())


def test_parts_merge_by_sums(spark, skewed):
    whole = sketches.summarise(skewed, {"k": F.col("k")}, {"v": F.col("v")})
    halves = [sketches.summarise(skewed.where(f"pmod(hash(v, w), 2) = {i}"), {"k": F.col("k")}, {"v": F.col("v")}) for i in range(2)]
    sums = halves[0].cells.union(halves[1].cells).groupBy("k", "category", "depth", "bucket").agg(F.sum("n").alias("n"))
    assert rows(sums) == rows(whole.cells)
    all_keys = sketches.regrouped(whole, lambda d: d.drop("k"), ())
    assert all_keys.cells.where("depth = 3").agg(F.sum("n")).first()[0] == skewed.where("v is not null").count()
    top = [r["value"] for r in sketches.heavy_hitters(all_keys, 5).orderBy(F.desc("n"), "value").collect()]
    counts = Counter(r["v"] for r in skewed.collect() if r["v"])
    assert len(top) == 5 and all(counts[v] >= sorted(counts.values(), reverse=True)[9] for v in top)


def test_many_keys_are_sent_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i % 150, f"v{i % 4}") for i in range(1500)], "k int, v string").repartition(2)
    found = sketches.heavy_hitters(sketches.summarise(df, {"k": F.col("k")}, {"v": F.col("v")}), 9)
    counts = Counter((r["k"], r["v"]) for r in df.collect())
    assert {(r["k"], r["value"]): r["n"] for r in found.collect()} == dict(counts)


def test_frequent_values_outlive_rare_ones():
    task = sketches._Task(sketches.Shape(eps=0.1), ["v"])
    rng, counts = random.Random(1), Counter()
    for _ in range(60):
        batch = Counter(["big"] * 13 + [f"r{rng.randrange(10**9)}" for _ in range(87)])
        counts += batch
        task.add(("k",), 0, list(batch), np.array([hash(v) for v in batch]), np.array(list(batch.values())))
        assert len(task.seen["k", 0]) <= task.most
    assert "big" in task.seen["k", 0] and counts["big"] > 0.1 * counts.total()


def test_empty_tables_and_values(spark):
    none = spark.createDataFrame([], "k string, v string")
    sketch = sketches.summarise(none, {"k": F.col("k")}, {"v": F.col("v")})
    assert sketches.heavy_hitters(sketch).count() == sketches.totals(sketch).count() == 0
    nulls = spark.createDataFrame([("a", None), ("a", "")], "k string, v string")
    assert rows(sketches.heavy_hitters(sketches.summarise(nulls, {"k": F.col("k")}, {"v": F.col("v")}))) == [("a", "v", "", 1)]


def test_group_statistics_by_sketches_equal_the_exact_ones(spark):
    rng = random.Random(8)
    made = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "h"]), rng.random(), f"c{int(rng.expovariate(0.2))}") for _ in range(2000)]
    df = spark.createDataFrame(made, "b int, h string, v double, c string").repartition(4)
    made_by = {a: groups.bidder_statistics(df, F.col("b"), F.col("h"), moments={"v": F.col("v")}, categories={"c": F.col("c")}, approx=a) for a in (False, True)}
    assert rows(made_by[True].categories, "bidder", "grp", "measure", "value", "n") == rows(made_by[False].categories, "bidder", "grp", "measure", "value", "n")
    assert [r[:4] for r in rows(made_by[True].moments)] == [r[:4] for r in rows(made_by[False].moments)]


def test_a_huge_value_does_not_blur_the_rest(spark):
    rng = random.Random(5)
    made = [(1, None, 1e9), (2, "h", 1e9)] + [(1, "h", 1 + rng.random()) for _ in range(40)] + [(2, None, 1 + rng.random()) for _ in range(40)]
    df = spark.createDataFrame(made, "b int, h string, v double").repartition(3)
    stats = groups.bidder_statistics(df, F.col("b"), F.col("h"), moments={"v": F.col("v")})
    found = {(r["bidder"], r["grp"]): r for r in groups.compare_with_rest(stats).collect()}
    # of bidder 1 the rest of NO-HASH are the forty values near 1
    values = [v for b, h, v in made if b == 1 and h]
    rest = {(r["bidder"], r["grp"]): r for r in stats.rests.collect()}["1", groups.NO_HASH]
    assert rest["n"] == 40 and math.isclose(rest["m2"] / 40, statistics.pvariance(values), rel_tol=1e-9)
    z = (1e9 - statistics.fmean(values)) / math.sqrt(statistics.pvariance(values) / 40)
    assert math.isclose(found["1", groups.NO_HASH]["z"], z, rel_tol=1e-9)


def test_a_rest_without_spread_has_none(spark):
    made = [(1, None, 3.0), (1, None, 5.0)] + [(b, "h", 0.1) for b in (1, 2, 3) for _ in range(7)]
    df = spark.createDataFrame(made, "b int, h string, v double").repartition(5)
    stats = groups.bidder_statistics(df, F.col("b"), F.col("h"), moments={"v": F.col("v")})
    rest = {(r["bidder"], r["grp"]): r["m2"] for r in stats.rests.collect()}
    assert rest["ALL", groups.NO_HASH] == 0.0
    with pytest.raises(ValueError, match="bidder_statistics"):
        groups.compare_with_rest(groups.group_aggregates(groups.fan_out_groups(df, F.col("b"), F.col("h")), moments={"v": F.col("v")}))


def test_asked_rows_are_not_broadcast(spark):
    rows = spark.range(3000).selectExpr("id % 2 as k", "cast(id as string) as v", "cast(null as string) as other")
    found = sketches.summarise(rows, {"k": F.col("k")}, {"v": F.col("v")}, sketches.Shape(0.1, 0.01))
    asked = sketches.estimates(found, rows.select("k", F.lit("v").alias("category"), F.col("v").alias("value")))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    # the one join that may be broadcast is that with the cells, whose number the sketch's shape bounds
    assert plan.count("BroadcastExchange") <= 1 and "SortMergeJoin" in plan
    assert asked.count() == 3000 and asked.where("n < 1").isEmpty()
