"""Bucketed snapshots: same results as the plain merge, no exchange of the snapshot, buckets kept from day to day."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hashgrove.operators import identity, traffic
from hashgrove.sources import snapshots
from hashgrove.sources.dated import day_folder
from helpers import rows

DAY = date(2024, 1, 15)
BUCKETS = 6


def feeds(spark, seed, n=200):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, "hot", *[f"k{i}" for i in range(60)]])
    current = [(key(), rng.choice(["", f"i{i}"]), rng.choice([None, f"o{i}"])) for i in range(n)]
    delta = [(key(), f"d{i}") for i in range(40)]
    oracle = [(key(), rng.choice(["", f"n{i}"])) for i in range(50)]
    return (
        spark.createDataFrame(current, "email_hash string, idl string, oracle_id string").repartition(3),
        spark.createDataFrame(delta, "email_hash string, idl string").repartition(2),
        spark.createDataFrame(oracle, "email_hash string, oracle_id string").repartition(2),
    )


def in_right_buckets(spark, folder):
    """Whether each file of the buckets holds its bucket's keys and no others."""
    files = list(Path(folder).glob("hot=false/*.parquet"))
    for file in files:
        bucket = int(re.search(r"_(\d+)(?:\..*)?$", file.name)[1])
        assert spark.read.parquet(str(file)).where(F.pmod(F.hash("email_hash"), F.lit(BUCKETS)) != bucket).isEmpty()
    return len(files)


@pytest.mark.parametrize(("seed", "hot"), [(1, 100_000), (2, 3), (3, 1), (4, 0)])
def test_days_are_merged_as_without_buckets(spark, tmp_path, seed, hot):
    current, delta, oracle = feeds(spark, seed)
    snapshots.write_bucketed(current, day_folder(str(tmp_path), DAY), "email_hash", BUCKETS, hot)
    assert rows(snapshots.read_snapshot(spark, day_folder(str(tmp_path), DAY))) == rows(current)
    expected = current
    for k in range(2):
        _, delta, oracle = feeds(spark, seed + 10 + k)
        oracle = oracle.where("email_hash <> 'hot'") if k else oracle  # keeps the product of hot rows small
        snapshots.merge_day(spark, str(tmp_path), DAY + timedelta(days=k + 1), delta, oracle, "email_hash", BUCKETS, hot)
        expected = spark.createDataFrame(identity.merge_identities(expected, delta, oracle).drop("presence").collect(), current.schema)
        folder = day_folder(str(tmp_path), DAY + timedelta(days=k + 1))
        assert rows(snapshots.read_snapshot(spark, folder)) == rows(expected)
        assert in_right_buckets(spark, folder) > 0 or hot == 0
        crowded = snapshots.read_snapshot(spark, folder).where("email_hash is not null").groupBy("email_hash").count().where(F.col("count") > max(1, hot) * 50)
        beside = snapshots.beside(spark, folder, current.schema)
        assert beside.where("email_hash is null").count() == expected.where("email_hash is null").count()
        assert crowded.join(beside, "email_hash", "left_anti").isEmpty()


def exchanged(plan: str) -> list[str]:
    """Scans of bucketed tables that lie below an exchange, in a printed physical plan."""
    above: list[tuple[int, str]] = []
    found = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [a for a in above if a[0] < depth]
        node = line.lstrip(" :+-*0123456789()")
        if node.startswith("FileScan") and "Bucketed: true" in line and any(n.startswith(("Exchange", "BroadcastExchange")) for _, n in above):
            found.append(node)
        above.append((depth, node))
    return found


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_snapshot_is_not_exchanged(spark, tmp_path, monkeypatch):
    current, delta, oracle = feeds(spark, 5)
    root = str(tmp_path)
    snapshots.write_bucketed(current, day_folder(root, DAY), "email_hash", BUCKETS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = []
        monkeypatch.setattr(snapshots, "_save", lambda marked, folder, key, buckets, save=snapshots._save: (plans.append(plan_of(marked)), save(marked, folder, key, buckets)))
        snapshots.merge_day(spark, root, DAY + timedelta(days=1), delta, oracle, "email_hash", BUCKETS)
        (plan,) = plans
        # the rows of hot keys are looked up with a join against the snapshot as well, before it is given up
        main = [scan for scan in exchanged(plan) if "_idl" in scan]
        assert plan.count("Bucketed: true") >= 3 and main == [] and "Exchange hashpartitioning" in plan
        assert exchanged(plan_of(current.groupBy("email_hash").count())) == []
        files = in_right_buckets(spark, day_folder(root, DAY + timedelta(days=1)))
        assert 0 < files <= 3 * BUCKETS
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_state_merged_day_by_day_finds_all_scrapers(spark, tmp_path):
    rng = random.Random(6)
    made = [(i, rng.choice(["", None, *[f"f{k}" for k in range(300)]]), rng.choice(["", None, "l1", "l1", "l1", f"l{i % 5}"]), i % 3) for i in range(1500)]
    events = spark.createDataFrame(made, "id int, first_party_id string, third_party_id string, day int").repartition(4)
    for day in range(3):
        state = snapshots.merge_state(spark, str(tmp_path), DAY + timedelta(days=day), traffic.day_ids(events.where(f"day = {day}")), "first_party_id", "least", "greatest", BUCKETS)
        so_far = events.where(f"day <= {day}")
        assert rows(traffic.known_scrapers(state)) == rows(traffic.scraper_ids(so_far).select("first_party_id"))
    kept = traffic.remove_known(events, traffic.known_scrapers(state))
    assert rows(kept) == rows(traffic.remove_scrapers(events))
    # a day without rows changes nothing
    last = snapshots.merge_state(spark, str(tmp_path), DAY + timedelta(days=3), traffic.day_ids(events.limit(0)), "first_party_id", "least", "greatest", BUCKETS)
    assert rows(last) == rows(state)


def test_an_empty_snapshot(spark, tmp_path):
    current, delta, oracle = feeds(spark, 9)
    root = str(tmp_path)
    snapshots.write_bucketed(current.limit(0), day_folder(root, DAY), "email_hash", BUCKETS)
    assert snapshots.read_snapshot(spark, day_folder(root, DAY), current.schema).count() == 0
    snapshots.merge_day(spark, root, DAY + timedelta(days=1), delta, oracle, "email_hash", BUCKETS)
    expected = identity.merge_identities(current.limit(0), delta, oracle).drop("presence")
    assert rows(snapshots.read_snapshot(spark, day_folder(root, DAY + timedelta(days=1)))) == rows(expected)
