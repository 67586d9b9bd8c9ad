from __future__ import annotations

import math
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashgrove import session
from hashgrove.functions.sizes import size_estimate
from hashgrove.operators import nested, vitals
from hashgrove.operators.quantiles import exact_quantiles
from hashgrove.sources.views import read_view
from helpers import rows


def test_map_merge_agg(spark):
    df = spark.createDataFrame([("u", {"a": 1, "b": 2}), ("u", {"a": 3}), ("v", None)], "u string, m map<string,int>")
    assert rows(nested.map_merge_agg(df, ["u"], "m", F.sum)) == [("u", "a", 4), ("u", "b", 2)]
    assert nested.map_merge_agg(df, ["u"], "m", F.max, as_map=True).first()["m"] == {"a": 3, "b": 2}


def test_sizes(spark):
    df = spark.createDataFrame([("g", 1, "ab"), ("g", 2, None)], "g string, id int, t string")
    assert rows(nested.with_size(df), "id", "bytes") == [(1, 24 + 10 + 8 + 12), (2, 24 + 10 + 8 + 8)]
    assert rows(nested.size_by_column(df)) == [("g", 20, 10), ("id", 16, 8), ("t", 20, 12)]


def test_outliers_keep_the_largest(spark):
    lengths = [10] * 50 + [11] * 50 + [500, 400, 300]
    df = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate(lengths)], "g string, id int, t string")
    assert rows(nested.size_outliers(df, "id", "g", top=2), "id", "rank") == [(100, 1), (101, 2)]
    assert nested.size_outliers(df, "id", "g").count() == 3


READINGS = (
    "person_id int, ts timestamp_ntz, body_temperature double, heart_rate int, blood_oxygen int,"
    " age int, location int, confirmed boolean"
)


def test_person_day_and_deviation(spark):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    df = spark.createDataFrame(
        [(1, at(1, 1), 36.0, 60, None, 30, 5, False), (1, at(1, 9), 38.0, 62, None, 30, 5, True),
         (1, at(2, 1), 40.0, 64, 95, 30, 5, False), (2, at(1, 1), None, 70, 97, 40, 5, False)],
        READINGS,
    )
    days = {(r.person_id, r.day.day): r for r in vitals.person_day(df).collect()}
    first = days[1, 1]
    assert (first.body_temperature_mean, first.body_temperature_min, first.body_temperature_max) == (37.0, 36.0, 38.0)
    assert first.blood_oxygen_missing and first.blood_oxygen_mean == 95.0 and first.confirmed
    assert days[2, 1].body_temperature_missing and days[2, 1].body_temperature_mean == 38.0
    deviation = {(r.person_id, r.day.day): r.deviation for r in vitals.baseline_deviation(df).collect()}
    assert deviation == {(1, 1): None, (1, 2): 3.0, (2, 1): None}
    rates = {r.day.day: (r.persons, r.rate) for r in vitals.location_rate(df).collect()}
    assert rates == {1: (2, 0.5), 2: (1, 0.0)}


def test_quantiles_are_exact(spark):
    rng = random.Random(1)
    values = [(g, None if rng.random() < 0.1 else rng.randint(0, 50)) for g in ("a", "a", "a", "b", None) for _ in range(rng.randint(1, 300))]
    found = {r["g"]: r["q"] for r in exact_quantiles(spark.createDataFrame(values, "g string, v int").repartition(7), "g", "v", [0.25, 0.5, 1.0]).collect()}
    for g in ("a", "b", None):
        own = sorted(v for k, v in values if k == g and v is not None)
        assert found[g] == [own[math.ceil(len(own) * p) - 1] for p in (0.25, 0.5, 1.0)]


def test_binary_values_and_unknown_types_have_sizes_or_raise(spark):
    assert rows(spark.range(1).select(size_estimate(F.lit(b"abc"), T.BinaryType()).alias("n"))) == [(11,)]
    with pytest.raises(TypeError, match="variant"):
        size_estimate(F.lit(None), T.VariantType())


def test_classifier_splits_by_person(spark):
    readings = read_view(spark, "/root/testdata/sf0.01", "vitals")
    scores, area = vitals.confirmed_classifier(readings)
    found = scores.collect()
    held_out = [r for r in found if not r.train]
    assert 0 < len(held_out) < len(found) == readings.select("person_id").distinct().count()
    assert all(0 <= r.score <= 1 for r in found) and 0 <= area <= 1


def test_materialize_keeps_the_schema(spark):
    df = spark.range(3).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    written = session.materialize(df, "test")
    assert written.schema.simpleString() == df.schema.simpleString()
    assert rows(written, "id") == [(0,), (1,), (2,)]


def test_release_deletes_what_was_written(spark):
    path = session.fresh_path(spark, "gone")
    spark.range(1).write.parquet(path)
    session._written[spark.sparkContext.applicationId] = [path]
    session.release(spark)
    assert not Path(path).exists()


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("__", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(spark__master="yarn"))
    assert session.shared_folder(Session(spark__master="yarn", spark__checkpoint__dir="hdfs:///x/")) == "hdfs:///x"
