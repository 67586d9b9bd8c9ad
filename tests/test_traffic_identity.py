from __future__ import annotations

from datetime import date
from itertools import product

import pytest
from pyspark.sql import functions as F

from hashgrove.operators import identity, keyed, traffic
from hashgrove.sources.dated import day_folder, read_day
from helpers import rows

EVENTS = "event_id int, first_party_id string, third_party_id string"


def test_remove_scrapers(spark):
    events = [
        (1, "f1", "l1"), (2, "f1", "l1"),
        (3, "f2", "l1"), (4, "f2", "l2"), (5, "f2", None),
        (6, "f3", "l1"), (7, "f3", ""),
        (8, "", "l1"), (9, "", "l2"),
        (10, None, "l1"), (11, None, "l2"),
    ]
    df = spark.createDataFrame(events, EVENTS)
    assert {r.event_id for r in traffic.remove_scrapers(df).collect()} == {1, 2, 6, 7, 8, 9, 10, 11}
    assert rows(traffic.scraper_ids(df)) == [("f2", 2)]


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
SMALL_SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@pytest.fixture
def unhelped(spark):
    """Joins without broadcasts, and skew found at the size of tests."""
    options = NO_BROADCAST | SMALL_SKEW
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot_rows(spark, n=6000):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string")))
    return spark.range(0, n, 1, 16).select("id", key.alias("key"), F.md5(F.col("id").cast("string")).alias("load"))


def test_remove_scrapers_with_a_hot_key(unhelped):
    df = _hot_rows(unhelped).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 10 != 0, F.col("key")).alias("first_party_id"),
        F.when(F.col("id") % 900 < 50, F.col("id") % 7).otherwise(F.lit(1)).cast("string").alias("third_party_id"),
    )
    events = [tuple(r) for r in df.collect()]
    seen: dict[str, set] = {}
    for _, cookie, third in events:
        seen.setdefault(cookie, set()).add(third)
    expected = {e for e, cookie, _ in events if cookie is None or len(seen[cookie]) < 2}
    found = [r.event_id for r in traffic.remove_scrapers(df).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_a_hot_key_is_split_over_tasks(unhelped):
    df = _hot_rows(unhelped)
    counts = df.groupBy("key").agg(F.count("*").alias("n"))
    joined = keyed.left_join(df, counts, ["key"])
    found = joined.select("key", "n", F.spark_partition_id().alias("p")).collect()
    expected = dict(rows(counts))
    assert len(found) == 6000 and all(r.n == expected[r.key] for r in found)
    assert len({r.p for r in found if r.key == "hot"}) > 1


def test_rows_of_one_key_get_different_places(spark):
    df = _hot_rows(spark).repartition(8, "key").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    places = df.where("key = 'hot'").select(keyed.place_of(df, 64).alias("p")).distinct().count()
    assert places == 64


@pytest.mark.parametrize("null_safe", [False, True])
def test_left_join_of_nulls_and_absent_keys(spark, null_safe):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "z", 1), (4, "a", 2)], "id int, key string, other int")
    table = spark.createDataFrame([("a", 1, "x"), (None, 1, "y")], "key string, other int, v string")
    found = keyed.left_join(df, table, ["key", "other"], null_safe)
    assert found.columns == ["id", "key", "other", "v"]
    assert rows(found, "id", "v") == [(1, "x"), (2, "y" if null_safe else None), (3, None), (4, None)]


def test_merge_plan_is_small(unhelped):
    current = unhelped.createDataFrame([("a", "i", "o")], "email_hash string, idl string, oracle_id string")
    delta = unhelped.createDataFrame([("a", "n"), ("a", "m")], "email_hash string, idl string")
    oracle = unhelped.createDataFrame([("a", "p"), ("b", "q")], "email_hash string, oracle_id string")
    merged = identity.merge_identities(current, delta, oracle)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert rows(merged) == [("a", "n", "p", "current+delta+oracle"), ("b", None, "q", "oracle")]
    assert plan.count("Scan ") <= 10 and "FullOuter" not in plan


def test_merge_with_hot_keys(unhelped):
    spark = unhelped
    current = [("hot", f"i{i}", None) for i in range(3)] + [("x", "ix", "ox")]
    oracle = [("hot", f"o{i}") for i in range(40)] + [("gone", f"o{i}") for i in range(40)]
    found = rows(_merge(spark, current, [("hot", "new"), ("d", "only")], oracle))
    assert found == sorted(
        [("hot", "new", f"o{i}", "current+delta+oracle") for i in range(40)] * 3
        + [("gone", None, f"o{i}", "oracle") for i in range(40)]
        + [("x", "ix", "ox", "current"), ("d", "only", None, "delta")],
        key=repr,
    )


def test_expand_raw(spark):
    raw = [(1, "h", " a ;; b"), (2, "h", None), (3, "h", " ; "), (4, "h", "c")]
    df = identity.expand_raw(spark.createDataFrame(raw, "seq int, email_hash string, idls string"), "idls", "idl")
    assert rows(df, "seq", "pos", "idl") == [(1, 0, "a"), (1, 2, "b"), (4, 0, "c")]


def test_reduce_delta_takes_newest_filled(spark):
    delta = [("h", "a", 1, 0), ("h", "b", 2, 0), ("h", "", 3, 0), ("g", "", 1, 0), ("k", "x", 1, 1), ("k", "y", 1, 0)]
    df = spark.createDataFrame(delta, "email_hash string, idl string, seq int, pos int")
    assert rows(identity.reduce_delta(df)) == [("h", "b"), ("k", "x")]


def _merge(spark, current, delta, oracle):
    return identity.merge_identities(
        spark.createDataFrame(current, "email_hash string, idl string, oracle_id string"),
        spark.createDataFrame(delta, "email_hash string, idl string"),
        spark.createDataFrame(oracle, "email_hash string, oracle_id string"),
    )


def test_merge_all_presence_patterns(spark):
    current, delta, oracle, expected = [], [], [], []
    for i, (c, d, o) in enumerate(product([False, True], repeat=3)):
        if not (c or d or o):
            continue
        key = f"h{i}"
        if c:
            current.append((key, "old", "oldo"))
        if d:
            delta.append((key, "new"))
        if o:
            oracle.append((key, "newo"))
        sides = [n for n, there in (("current", c), ("delta", d), ("oracle", o)) if there]
        expected.append(
            (key, "new" if d else "old" if c else None, "newo" if o else "oldo" if c else None, "+".join(sides))
        )
    assert rows(_merge(spark, current, delta, oracle)) == sorted(expected, key=repr)


def test_merge_repeats_multiply_and_null_keys_stay_apart(spark):
    found = rows(
        _merge(
            spark,
            [("a", "i1", None), ("a", "i2", None), (None, "n", None)],
            [("a", ""), (None, "d")],
            [("a", "o1"), ("a", "o2"), (None, "o")],
        )
    )
    assert found == sorted(
        [("a", i, o, "current+delta+oracle") for i in ("i1", "i2") for o in ("o1", "o2")]
        + [(None, "n", None, "current"), (None, "d", None, "delta"), (None, None, "o", "oracle")],
        key=repr,
    )


def test_feed_interval():
    days = (date(2021, 2, 20), date(2021, 2, 24))
    before = (date(2021, 2, 23), date(2021, 2, 23))
    assert identity.feed_interval(days) == before
    assert identity.feed_interval(days, whole_interval=True) == days
    assert identity.feed_interval(days, partner_interval=True) == days


def test_update_snapshot_cycle(spark, tmp_path):
    root, yesterday, today = str(tmp_path / "snap"), date(2021, 2, 23), date(2021, 2, 24)
    first = spark.createDataFrame([("a", "i", "o"), ("b", "j", None)], "email_hash string, idl string, oracle_id string")
    first.write.parquet(day_folder(root, yesterday))
    delta = spark.createDataFrame([("b", "new"), ("c", "k")], "email_hash string, idl string")
    oracle = spark.createDataFrame([("b", "p")], "email_hash string, oracle_id string")
    for _ in range(2):  # a second run replaces the day
        identity.update_snapshot(spark, root, today, delta, oracle)
    assert rows(read_day(spark, root, today)) == [("a", "i", "o"), ("b", "new", "p"), ("c", "k", None)]
    assert rows(read_day(spark, root, yesterday)) == [("a", "i", "o"), ("b", "j", None)]
