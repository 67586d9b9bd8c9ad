from __future__ import annotations

import gzip
import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hashgrove.operators import audit
from hashgrove.sources import dated, markers, sharded
from hashgrove.sources.text import write_text
from helpers import rows

FILES = "committed_by string, path_shard string, part_no int, job_id string, bytes bigint"


def test_completeness_and_missing_parts(spark):
    df = spark.createDataFrame(
        [("0", "0", 0, "j0", 5), ("0", "0", 1, "j0", 5), ("0", "0", 1, "j0", 5), ("2", "2", 2, "j2", 7), ("2", "6", 0, "j2", 1), ("6", "6", 1, "j2", None)],
        FILES,
    )
    shards = ["0", "2", "6", "s"]
    assert rows(audit.shard_completeness(df, shards, 3)) == [
        ("0", 3, 15, 2, 1, False), ("2", 1, 7, 1, 2, False), ("6", 2, 1, 2, 1, False), ("s", 0, 0, 0, 3, False)
    ]
    assert rows(audit.missing_parts(df, shards, 3)) == [("0", 2), ("2", 0), ("2", 1), ("6", 2), ("s", 0), ("s", 1), ("s", 2)]
    assert rows(audit.cross_shard_commits(df)) == [("2", "6", 1)]
    assert rows(audit.job_id_collisions(df)) == [("j2", 2)]


def test_overlapping_windows(spark):
    df = spark.createDataFrame(
        [("j", 1, 0, 10), ("j", 2, 5, 6), ("j", 3, 10, 12), ("k", 1, 0, 3), ("k", 1, 2, 5), ("k", 2, 5, 9)],
        "job_id string, committed_by int, started int, finished int",
    )
    assert rows(audit.overlapping_windows(df)) == [("j", 1)]


@pytest.mark.parametrize(
    ("day", "keep"),
    [("2021-02-24", True), ("2021-02-18", True), ("2021-02-17", False), ("2021-02-25", False),
     ("2021-02-01", True), ("2020-03-01", True), ("2020-02-01", False), ("2020-03-02", False)],
)
def test_retention(spark, day, keep):
    df = spark.createDataFrame([(day,)], "d string")
    plan = audit.retention_plan(df, "d", date(2021, 2, 24))
    assert rows(plan, "keep") == [(keep,)]


def test_volume_checks(spark):
    counts = [10, 10, 10, 5, 20]
    df = spark.createDataFrame(
        [("e", date(2024, 1, i + 1), n) for i, n in enumerate(counts)], "entity string, day date, n bigint"
    )
    drops = {r.day.day: r.dropped for r in audit.volume_drop(df).collect()}
    assert drops == {1: False, 2: False, 3: False, 4: True, 5: False}
    z = {r.day.day: r.z for r in audit.daily_anomaly(df).collect()}
    # three equal days give no spread, then 10, 10, 10, 5
    assert z[1] is z[2] is z[3] is z[4] is None
    assert z[5] == pytest.approx((20 - 8.75) / 2.1650635)


def test_a_day_without_rows_is_seen(spark):
    volume = spark.createDataFrame(
        [("e", date(2024, 1, 1), 9), ("e", date(2024, 1, 3), 9), ("f", date(2024, 1, 3), 4)], "entity string, day date, n bigint"
    )
    found = {(r.entity, r.day.day): (r.n, r.ratio, r.dropped) for r in audit.volume_drop(volume, last=date(2024, 1, 4)).collect()}
    assert found == {
        ("e", 1): (9, None, False), ("e", 2): (0, 0.0, True), ("e", 3): (9, None, False), ("e", 4): (0, 0.0, True),
        ("f", 3): (4, None, False), ("f", 4): (0, 0.0, True),
    }


@pytest.mark.parametrize(
    ("path", "uri"),
    [("file:/a/b", "file:///a/b"), ("file:///a", "file:///a"), ("s3a://b/k", "s3://b/k"), ("s3n://b/k", "s3://b/k"), ("hdfs://n/a", "hdfs://n/a")],
)
def test_paths_become_readable_uris(path, uri):
    assert markers.readable_uri(path) == uri


def test_writers_open_few_files(spark, tmp_path):
    rows_ = spark.range(0, 4000, 1, 16).select("id", F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 3).cast("int")).alias("date"))
    dated.write_dated(rows_, str(tmp_path / "d"), files_per_day=4)
    for day in (tmp_path / "d").glob("date=*"):
        assert 1 <= len(list(day.glob("part-*"))) <= 4
    write_text(rows_.select("date", "id"), str(tmp_path / "t"), partition_by="date", files_per_value=2)
    for day in (tmp_path / "t").glob("date=*"):
        assert 1 <= len(list(day.glob("part-*"))) <= 2


def test_running_tasks(spark):
    df = spark.createDataFrame(
        [("d", "x", "running", "Op", "t1"), ("d", "x", "queued", "Op", "t2"), ("d", "x", "success", "Op", "t3"),
         ("d", "x", "running", "S3KeySensor", "t4"), ("d", "x", "running", "Op", "Check_running_tasks")],
        "dag_id string, execution_date string, state string, operator string, task_id string",
    )
    assert rows(audit.running_tasks(df)) == [("d", "x", 2)]


# --- markers


def put_marker(root: Path, shard: str, files: list[str], finished_ms: int, job: str) -> None:
    folder = root / shard / "20210224"
    folder.mkdir(parents=True)
    document = {
        "name": "SuccessData/1",
        "timestamp": finished_ms,
        "date": "Sat Feb 27 00:00:10 UTC 2021",
        "hostname": f"host-{shard}",
        "committer": "directory",
        "description": f"Task committer attempt_{job}_0000_m_000000_0",
        "metrics": {"committer_commits_completed": len(files), "committer_bytes_committed": 7, "ops (Hz)": 0},
        "diagnostics": {"a": "b"},
        "filenames": files,
    }
    (folder / "_SUCCESS").write_text(json.dumps(document, indent=1))


def name(shard: str, part: int) -> str:
    return f"/daily/{shard}/20210224/part-r-{part:05d}-job_20210227000000_0000.gz"


@pytest.fixture
def marker_root(tmp_path):
    start = 1614384000000  # 2021-02-27 00:00:00 UTC
    put_marker(tmp_path, "2", [name("2", 0), name("6", 0), name("6", 1)], start + 10_000, "20210227000000")
    put_marker(tmp_path, "6", [name("6", 2)], start + 12_000, "20210227000000")
    return tmp_path


def test_markers(spark, marker_root):
    found = markers.read_markers(spark, f"{marker_root}/*/20210224/_SUCCESS")
    assert rows(found, "shard", "day", "hostname") == [("2", "20210224", "host-2"), ("6", "20210224", "host-6")]
    files = markers.marker_files(found)
    assert rows(files, "committed_by", "path_shard", "part_no", "codec") == [
        ("2", "2", 0, "gz"), ("2", "6", 0, "gz"), ("2", "6", 1, "gz"), ("6", "6", 2, "gz")
    ]
    assert {r.job_id for r in files.collect()} == {"job_20210227000000_0000"}
    assert rows(audit.cross_shard_commits(files)) == [("2", "6", 2)]
    assert rows(audit.job_id_collisions(files)) == [("job_20210227000000_0000", 2)]
    summary = markers.marker_summary(found)
    assert rows(summary, "committed_by", "declared", "listed", "bytes", "elapsed_s") == [
        ("2", 3, 3, 7, 10), ("6", 1, 1, 7, 12)
    ]
    assert rows(audit.declared_against_listed(summary, 3), "committed_by") == [("6",)]
    spread = {r.metric: (r.least, r.greatest) for r in audit.metric_spread(markers.marker_metrics(found)).collect()}
    assert spread["committer_commits_completed"] == (1, 3) and spread["ops (Hz)"] == (0, 0)


def test_commit_window_ignores_the_session_time_zone(spark, marker_root):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = markers.marker_summary(markers.read_markers(spark, f"{marker_root}/2/*/_SUCCESS"))
        assert rows(found, "elapsed_s") == [(10,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_markers(spark, tmp_path):
    assert markers.read_markers(spark, f"{tmp_path}/*/_SUCCESS").count() == 0


def test_malformed_file_name(spark):
    df = spark.createDataFrame([("/x/readme.txt",)], "filename string")
    assert rows(markers.parse_file_names(df), "path_shard", "part_no") == [("", None)]


def test_input_readiness(spark):
    required = spark.createDataFrame(
        [("j1", "a", "d"), ("j1", "b", "d"), ("j2", "a", "d")], "job string, input string, day string"
    )
    listed = spark.createDataFrame([("a", "d"), ("a", "d"), ("b", "e")], "input string, day string")
    assert rows(markers.input_readiness(required, listed)) == [("j1", False, 1), ("j2", True, 0)]


# --- dated, text and sharded output


def test_dated_write_replaces_only_its_days(spark, tmp_path):
    root = str(tmp_path / "t")
    days = lambda *d: spark.createDataFrame(d, "x int, date date")
    dated.write_dated(days((1, date(2024, 1, 1)), (2, date(2024, 1, 2))), root)
    dated.write_dated(days((3, date(2024, 1, 2))), root, days=[date(2024, 1, 2)])
    assert rows(dated.read_dated(spark, root, date(2024, 1, 1), date(2024, 1, 3)), "x") == [(1,), (3,)]
    assert rows(dated.read_dated(spark, root, date(2024, 1, 2), date(2024, 1, 2)), "x") == [(3,)]
    listed = markers.listed_inputs(spark, f"{tmp_path}/*/date=*/_SUCCESS")
    assert rows(listed) == [("t", "20240102")]
    required = spark.createDataFrame(
        [("j1", "t", "20240101"), ("j2", "t", "20240102")], "job string, input string, day string"
    )
    assert rows(markers.input_readiness(required, listed), "job", "ready") == [("j1", False), ("j2", True)]


def test_dated_read_prunes_folders(spark, tmp_path):
    root = str(tmp_path / "t")
    dated.write_dated(spark.createDataFrame([(1, date(2024, 1, 1))], "x int, date date"), root)
    plan = dated.read_dated(spark, root, date(2024, 1, 1), date(2024, 1, 1))
    assert "PartitionFilters: [isnotnull(date" in plan._jdf.queryExecution().executedPlan().toString()


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "n int, k string, v string")
    write_text(df, str(tmp_path / "json"))
    assert rows(spark.read.text(str(tmp_path / "json"))) == [('{"n":1,"k":"a"}',), ('{"n":2,"k":"b","v":"c"}',)]
    write_text(df, str(tmp_path / "one"), compression="gzip", separator="|", single_file=True)
    parts = list((tmp_path / "one").glob("part-*.gz"))
    assert len(parts) == 1
    assert sorted(gzip.open(parts[0], "rt").read().split()) == ["1|a|", "2|b|c"]
    write_text(df, str(tmp_path / "keyed"), partition_by="k", separator="|")
    assert sorted(p.name for p in (tmp_path / "keyed").glob("k=*")) == ["k=a", "k=b"]


def test_sharded_write_spreads_a_hot_key(spark, tmp_path):
    root = tmp_path / "s"
    key = F.when(F.col("id") % 3 == 0, F.lit("a-hot")).otherwise(F.md5(F.col("id").cast("string")))
    df = spark.range(0, 4000, 1, 16).select("id", key.alias("key"), F.lit(date(2024, 1, 1)).alias("date"))
    sharded.write_sharded(df, str(root), "key", tasks=8, files_per_shard=4)
    assert spark.read.parquet(str(root)).count() == 4000
    for shard in root.glob("shard=*"):
        assert len(list(shard.glob("date=*/*.parquet"))) <= 4
    hot = [spark.read.parquet(str(f)).count() for f in root.glob("shard=a/date=*/*.parquet")]
    assert len(hot) > 1 and max(hot) < 0.8 * sum(hot)
