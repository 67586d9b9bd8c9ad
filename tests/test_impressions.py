from __future__ import annotations

from pyspark.sql import functions as F

from hashgrove.operators import impressions
from helpers import rows

SCHEMA = (
    "impression_id bigint, ts timestamp_ntz, decision_id string, redecision_attempt int,"
    " is_first_impression boolean, is_broken_drop boolean, md5 string, sh1 string, sh2 string,"
    " template_id int, placement_id bigint"
)


def frame(spark, *impressions_):
    """Rows from dicts over defaults; ts as seconds."""
    base = {
        "ts": 0, "decision_id": None, "redecision_attempt": None, "is_first_impression": True,
        "is_broken_drop": False, "md5": None, "sh1": None, "sh2": None, "template_id": 1, "placement_id": 1,
    }
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    raw = SCHEMA.replace("ts timestamp_ntz", "ts bigint")
    data = [tuple({"impression_id": i, **base, **d}[n] for n in names) for i, d in enumerate(impressions_)]
    return spark.createDataFrame(data, raw).withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))


def test_dedupe_treats_missing_and_sentinel_alike(spark):
    df = frame(
        spark,
        {"ts": 5}, {"ts": 4, "decision_id": ""}, {"ts": 3, "redecision_attempt": -1},
        {"ts": 2, "decision_id": "", "redecision_attempt": -1}, {"ts": 1, "is_first_impression": False},
        {"ts": 1, "decision_id": "d"}, {"ts": 1, "decision_id": "d"}, {"ts": 0, "decision_id": "d", "redecision_attempt": 1},
    )
    assert rows(impressions.dedupe_impressions(df), "impression_id") == [(3,), (5,), (7,)]


def test_dedupe_limits_each_map_task_before_the_shuffle(spark):
    plan = impressions.dedupe_impressions(frame(spark, {}))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_broken_drop_keys(spark):
    df = frame(
        spark,
        {"is_broken_drop": True, "sh1": "", "sh2": "x", "template_id": None, "placement_id": None},
        {"is_broken_drop": True, "md5": ""}, {"is_broken_drop": True}, {"md5": "m"},
    )
    assert rows(impressions.broken_drop_keys(df)) == [("", 1, 1), ("x", -1, None)]


def test_flag_broken_drops_matches_null_placements(spark):
    df = frame(
        spark,
        {"is_broken_drop": True, "md5": "m", "placement_id": None},
        {"sh1": "m", "placement_id": None}, {"md5": "m", "placement_id": 1}, {"md5": "n", "placement_id": None},
        {"md5": "m", "placement_id": None, "template_id": 2},
    )
    flagged = impressions.flag_broken_drops(df)
    assert flagged.columns == df.columns
    assert rows(flagged.where("is_broken_drop"), "impression_id") == [(0,), (1,)]


def test_expected_profit(spark):
    df = spark.createDataFrame(
        [(1.0, None, 2.5, None), (None, None, None, None)],
        "actual_dsp_fee double, actual_pgm_fee double, actual_ssp_fee double, thirdparty_margin double",
    )
    assert [r[0] for r in df.select(impressions.expected_profit()).collect()] == [3.5, 0.0]
