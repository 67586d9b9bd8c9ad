from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hashgrove.functions import (
    browser_class,
    category_default,
    clean_name,
    device_class,
    dotted_tail,
    first_filled,
    hex_shard,
    map_merge,
    map_union_strict,
    os_class,
    path_label,
    row_size,
)
from helpers import rows


def one(spark, schema, values, column):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("values", "expected"),
    [((None, "", "x"), "x"), ((None, None, None), ""), (("a", "b", "c"), "a"), (("", "b", None), "b")],
)
def test_first_filled(spark, values, expected):
    columns = [F.col(c) for c in "abc"]
    assert one(spark, "a string, b string, c string", values, first_filled(*columns)) == expected


@pytest.mark.parametrize(
    ("value", "expected"), [(None, "D"), ("", "D"), ("UnKnown", "D"), ("CPM", "CPM")]
)
def test_category_default(spark, value, expected):
    column = category_default(F.col("a"), "D", unknown_is_missing=True)
    assert one(spark, "a string", (value,), column) == expected
    if value == "UnKnown":
        assert one(spark, "a string", (value,), category_default(F.col("a"), "D")) == "UnKnown"


def test_agent_classes(spark):
    agents = [
        ("Mozilla/5.0 (iPad; CPU OS 15_1 like Mac OS X) Version/15.1 Mobile/15E148 Safari/604.1",
         "Tablet", "iOS", "Safari"),
        ("Mozilla/5.0 (Linux; Android 12; Pixel 6) Chrome/96.0 Mobile Safari/537.36",
         "Smartphone", "Android", "Chrome"),
        ("Mozilla/5.0 (Linux; Android 12; SM-T870) Chrome/96.0 Safari/537.36",
         "Tablet", "Android", "Chrome"),
        ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Chrome/96.0 Safari/537.36 Edg/96.0",
         "Personal computer", "OS X", "Edge"),
        ("curl/7.8", None, None, None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(agents, "a string, d string, o string, b string")
    agent = F.col("a")
    for found in df.select("*", device_class(agent), os_class(agent), browser_class(agent)).collect():
        assert tuple(found[1:4]) == tuple(found[4:7])


def test_names(spark):
    assert one(spark, "a string", ("com.x.FooJob",), dotted_tail(F.col("a"))) == "FooJob"
    assert one(spark, "a string", ("FooJob",), dotted_tail(F.col("a"))) == "FooJob"
    column = clean_name(F.col("a"))
    assert one(spark, "a string", ("Yesterday s3 a/b available",), column) == "Yesterdays3abavailable"


@pytest.mark.parametrize(
    ("template", "expected"),
    [
        ("s3://acme-com/My Logs/x//{{ ds_nodash }}/_SUCCESS", "Today -my_logs-x available"),
        ("s3://acme-com/a/{{yesterday_ds_nodash}}/_SUCCESS", "Yesterday -a available"),
        ("s3://acme-com/a/{{ ts }}/_SUCCESS", None),
    ],
)
def test_path_label(spark, template, expected):
    assert one(spark, "a string", (template,), path_label(F.col("a"), drop=("acme-com",))) == expected


@pytest.mark.parametrize(
    ("key", "expected"), [("0a", "0"), ("f", "f"), ("g1", "s"), ("", "s"), (None, "s"), ("A1", "s")]
)
def test_hex_shard(spark, key, expected):
    assert one(spark, "a string", (key,), hex_shard(F.col("a"))) == expected


# --- maps


MAPS = "m1 map<string,int>, m2 map<string,int>"


@pytest.mark.parametrize(
    ("m1", "m2", "expected"),
    [
        (None, None, {}),
        (None, {"a": 1}, {"a": 1}),
        ({"a": 1}, None, {"a": 1}),
        ({"a": 1, "b": 2}, {"b": 3, "c": 4}, {"a": 1, "b": -1, "c": 4}),
        ({"a": None}, {"b": 1}, {"a": None, "b": 1}),
        ({"a": 1}, {"a": None}, {"a": None}),
        ({}, {}, {}),
    ],
)
def test_map_merge(spark, m1, m2, expected):
    merged = map_merge(F.col("m1"), F.col("m2"), lambda a, b: a - b)
    assert one(spark, MAPS, (m1, m2), merged) == expected


small_maps = st.none() | st.dictionaries(st.sampled_from("abcd"), st.integers(-9, 9), max_size=4)


@settings(max_examples=5, deadline=None)
@given(pairs=st.lists(st.tuples(small_maps, small_maps), min_size=20, max_size=40))
def test_map_merge_agrees_with_dicts(spark, pairs):
    merged = map_merge(F.col("m1"), F.col("m2"), lambda a, b: a * 10 + b)
    found = spark.createDataFrame(pairs, MAPS).select("m1", "m2", merged.alias("m")).collect()
    for m1, m2, m in found:
        left, right = m1 or {}, m2 or {}
        both = {k: left[k] * 10 + v if k in left else v for k, v in right.items()}
        assert m == {**left, **both}


def test_map_union_strict(spark):
    union = map_union_strict(F.col("m1"), F.col("m2"))
    assert one(spark, MAPS, ({"a": 1}, {"b": 2}), union) == {"a": 1, "b": 2}
    with pytest.raises(PySparkException, match="key in both maps: a"):
        one(spark, MAPS, ({"a": 1}, {"a": 2}), union)


# --- sizes


@pytest.mark.parametrize(
    ("schema", "values", "expected"),
    [
        ("a string, b int, c array<int>", ("blabla", 4, list(range(1, 9))), 188),
        ("a string", (None,), 16),
        ("a array<string>", ([],), 16),
        ("a map<string,int>", ({},), 16),
        ("a int", (None,), 16),
        ("a string", ("a\U0001f600",), 8 + 8 + 6),
        ("a array<string>", (["xy", "z"],), 8 + 8 + (8 + 8 + 4) + (8 + 8 + 2)),
        ("a map<string,int>", ({"xy": 1},), 8 + 8 + (16 + (8 + 4) + 8)),
        ("a struct<x:int,y:string>", ((1, "ab"),), 8 + (8 + 8) + (8 + 8 + 4)),
        ("a array<struct<x:int>>", ([(1,), (2,)],), 8 + 8 + 2 * (8 + 8 + 8)),
        ("a map<string,array<int>>", ({"k": [1, 2]},), 8 + 8 + 16 + 10 + (8 + 2 * 16)),
    ],
)
def test_row_size(spark, schema, values, expected):
    df = spark.createDataFrame([values], schema)
    assert df.select(row_size(df)).first()[0] == expected
