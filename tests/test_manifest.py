"""The sink with a manifest, its reader, and the audits on the facts of a day with lost output."""

from __future__ import annotations

import json
from datetime import date
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThanOrEqual

from hashgrove.operators import audit
from hashgrove.sources import dated, manifest, markers
from helpers import rows

SCHEMA = "shard string, day date, id int, name string"


def table(spark, n=60, shards="0as", days=(1, 2)):
    made = [(shards[i % len(shards)], date(2024, 1, days[i % len(days)]), i, f"n{i} é|") for i in range(n)]
    return spark.createDataFrame(made, SCHEMA).repartition(5)


def files_below(root: Path) -> set[str]:
    return {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def lines(spark, root, **where):
    found = manifest.read_committed(manifest.read_manifests(spark, str(root)))
    return sorted((r["shard"], r["day"], r["value"]) for r in found.collect())


@pytest.mark.parametrize("codec", list(manifest.CODECS))
def test_what_is_written_is_listed_and_read_back(spark, tmp_path, codec):
    df = table(spark)
    manifest.write_committed(df, str(tmp_path), "shard", "day", files_per_folder=4, codec=codec)
    expected = sorted((r["shard"], r["day"].strftime("%Y%m%d"), json.dumps({"id": r["id"], "name": r["name"]}, ensure_ascii=False, separators=(",", ":"))) for r in df.collect())
    assert lines(spark, tmp_path) == expected
    found = manifest.read_manifests(spark, str(tmp_path)).collect()
    assert len(found) == 6 and sum(r["metrics"]["records_written"] for r in found) == 60
    listed = {name for r in found for name in r["filenames"]}
    assert {str(tmp_path / f) for f in files_below(tmp_path) if not f.endswith("_SUCCESS")} == listed
    for r in found:
        assert 1 <= r["metrics"]["committer_commits_completed"] == len(r["filenames"]) <= 4
        assert r["metrics"]["committer_bytes_committed"] == sum(Path(f).stat().st_size for f in r["filenames"])
    parsed = markers.marker_files(manifest.read_manifests(spark, str(tmp_path)))
    assert all(r["committed_by"] == r["path_shard"] and r["codec"] == codec and 0 <= r["part_no"] < 4 and r["job_id"] for r in parsed.collect())
    assert all(r["elapsed_s"] >= 0 for r in markers.with_commit_window(manifest.read_manifests(spark, str(tmp_path))).collect())


def test_nulls_and_empty_tables(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, 1, None), ("s", None, None, "x"), ("7", date(2024, 2, 29), 3, "")], SCHEMA)
    manifest.write_committed(odd, str(tmp_path / "a"), "shard", "day", separator="|")
    assert lines(spark, tmp_path / "a") == [("7", "20240229", "3|"), ("s", "00000000", "1|"), ("s", "00000000", "|x")]
    manifest.write_committed(odd.limit(0), str(tmp_path / "b"), "shard", "day")
    assert manifest.read_manifests(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(Exception, match="use one of"):
        manifest.write_committed(odd, str(tmp_path / "c"), "shard", "day", codec="lzo")


def test_a_write_killed_half_way_leaves_nothing(spark, tmp_path):
    df = table(spark)
    died = df.withColumn("name", F.when(F.col("id") == 59, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    with pytest.raises(PySparkException, match="killed"):
        manifest.write_committed(died, str(tmp_path), "shard", "day", files_per_folder=9)
    assert files_below(tmp_path) == set()
    assert manifest.read_manifests(spark, str(tmp_path)).count() == 0
    manifest.write_committed(df, str(tmp_path), "shard", "day", files_per_folder=9)
    assert len(lines(spark, tmp_path)) == 60


def test_a_committed_folder_is_refused_or_replaced(spark, tmp_path):
    df = table(spark)
    manifest.write_committed(df.where("day = '2024-01-01'"), str(tmp_path), "shard", "day", files_per_folder=3)
    before, held = files_below(tmp_path), lines(spark, tmp_path)
    with pytest.raises(PySparkException, match="committed already"):
        manifest.write_committed(df, str(tmp_path), "shard", "day", files_per_folder=3)
    assert files_below(tmp_path) == before and lines(spark, tmp_path) == held
    again = df.where("day = '2024-01-01' and shard = 'a'").withColumn("name", F.lit("new"))
    manifest.write_committed(again, str(tmp_path), "shard", "day", files_per_folder=2, replace=True)
    after = lines(spark, tmp_path)
    assert [r for r in after if r[0] != "a"] == [r for r in held if r[0] != "a"]
    assert len([r for r in after if r[0] == "a"]) == again.count() and all('"new"' in r[2] for r in after if r[0] == "a")
    listed = {f for r in manifest.read_manifests(spark, str(tmp_path)).collect() for f in r["filenames"]}
    assert {str(tmp_path / f) for f in files_below(tmp_path) if not f.endswith("_SUCCESS")} == listed


def test_a_task_that_ran_twice_counts_once(tmp_path, spark):
    writer = manifest.ManifestWriter(str(tmp_path), "txt", False)
    batch = pa.record_batch([["0", "0"], ["20240101"] * 2, [0, 1], ["a", "b"]], names=["shard", "day", "part", "value"])
    lost = writer.write(iter([batch.slice(0, 1)]))  # of an executor that was lost: nobody hears of it
    assert [f.rows for f in lost.files] == [1]
    monkey = manifest.ManifestWriter(str(tmp_path), "txt", False)
    assert monkey.job != writer.job  # also within one second
    monkey.commit([monkey.write(iter([batch])), None])
    assert lines(spark, tmp_path) == [("0", "20240101", "a"), ("0", "20240101", "b")]
    assert len(files_below(tmp_path)) == 4


def put(root: Path, shard: str, day: str, text: str) -> None:
    (root / shard / day).mkdir(parents=True)
    (root / shard / day / "_SUCCESS").write_text(text)


def test_only_the_markers_asked_for_are_opened(spark, tmp_path):
    good = json.dumps({"name": "SuccessData/1", "metrics": {"n": 1}, "filenames": []})
    for shard in "012":
        for day in range(1, 7):
            # a marker that is opened but not asked for is an error
            put(tmp_path, shard, f"2024010{day}", good if shard == "1" and day in (3, 4) else "{ broken")
    found = manifest.read_manifests(spark, str(tmp_path))
    for asked in ("shard = '1' and day in ('20240103', '20240104')", "shard in ('1') and day >= '20240103' and day <= '20240104'", "day between '20240103' and '20240104' and shard = '1' and metrics['n'] = 1"):
        assert rows(found.where(asked), "shard", "day") == [("1", "20240103"), ("1", "20240104")]
    assert found.where("shard = '1' and day = '20240103' and name = 'x'").count() == 0
    assert found.where("shard = '9'").count() == found.where("shard = '1' and day = '20250101'").count() == 0
    with pytest.raises(PySparkException, match="is not a marker document"):
        found.where("day = '20240105'").collect()


def test_folders_named_by_filters_are_not_listed(tmp_path, monkeypatch):
    put(tmp_path, "0", "20240101", "")
    put(tmp_path, "a", "20240102", "")

    def planned(*filters):
        reader = manifest.MarkerReader(str(tmp_path))
        left = list(reader.pushFilters(list(filters)))
        return reader.places(), left

    later = GreaterThan(("day",), "20240101")
    assert planned(GreaterThanOrEqual(("day",), "20240102"), later) == ([("a", "20240102")], [later])
    assert planned(LessThanOrEqual(("day",), "20240101")) == ([("0", "20240101")], [])
    assert planned(EqualTo(("shard",), "a"), EqualTo(("shard",), "b")) == ([], [])
    inner = EqualTo(("metrics", "n"), 1)
    assert planned(inner)[1] == [inner]
    monkeypatch.setattr(manifest.fs, "FileSelector", lambda *a, **k: pytest.fail("a folder was listed"))
    assert planned(In(("shard",), ("a", "0")), EqualTo(("day",), "20240102"))[0] == [("0", "20240102"), ("a", "20240102")]


def test_many_folders_make_several_partitions(tmp_path):
    for day in range(70):
        put(tmp_path, "0", f"{20240000 + day}", "")
    parts = manifest.MarkerReader(str(tmp_path)).partitions()
    assert [len(p.places) for p in parts] == [32, 32, 6]
    assert manifest.MarkerReader(str(tmp_path / "none")).partitions()[0].places == []


def test_empty_markers_of_other_writers(spark, tmp_path):
    put(tmp_path, "0", "20240101", "")
    dated.mark_complete(spark, str(tmp_path / "x"), [date(2024, 1, 1)])
    found = manifest.read_manifests(spark, str(tmp_path)).where("day = '20240101'").collect()
    assert [(r["shard"], r["filenames"], r["name"]) for r in found] == [("0", None, None)]


# --- the day with lost output: 17 shards of 5,000 files, of which two shared a job id


SHARDS = "0123456789abcdefs"
#: Attempt times of the 17 jobs, shard by shard.
ATTEMPTS = (
    "20210227034512 20210227022950 20210227020013 20210227053419 20210227042448 20210227000529 20210227020013 20210227031237 20210227010936"
    " 20210227023021 20210227031252 20210227050251 20210227034501 20210227000529 20210227044148 20210227010944 20210227050210"
).split()


def incident(root: Path) -> None:
    """Marker documents that hold the facts of that day: the job of shard 2 published 3,340 files of shard 6, which kept two."""
    bytes_left = 5_737_455_170_968
    for k, (shard, attempt) in enumerate(zip(SHARDS, ATTEMPTS, strict=True)):
        parts = {"6": [4923, 4925]}.get(shard, range(5000))
        # which parts each of the two kept is not told apart here but for the two of shard 6
        moved = [p for p in range(5000) if p not in (4923, 4925)][:3340] if shard == "2" else []
        names = [f"/daily/{'6' if p in set(moved) else shard}/20210224/part-r-{p:05d}-job_{attempt}_0000.gz" for p in parts]
        size = bytes_left // (len(SHARDS) - k)
        bytes_left -= size
        document = {
            "name": "SuccessData/1", "timestamp": 1614392815958 + k, "date": "", "hostname": f"host-{k}", "committer": "directory",
            "description": f"Task committer attempt_{attempt}_0000_m_000000_0",
            "metrics": {"committer_commits_completed": len(names), "committer_bytes_committed": size}, "diagnostics": {}, "filenames": names,
        }
        put(root, shard, "20210224", json.dumps(document))


def test_facts_of_the_17_markers(spark, tmp_path):
    incident(tmp_path)
    found = manifest.read_manifests(spark, str(tmp_path)).where("day = '20210224'").persist()
    assert rows(found.drop("path"), "shard") == rows(markers.read_markers(spark, f"{tmp_path}/*/20210224/_SUCCESS"), "shard")
    summary = markers.marker_summary(found)
    assert summary.count() == 17 and summary.where("listed = 5000").count() == 16
    assert rows(audit.declared_against_listed(summary), "committed_by", "declared", "listed") == [("6", 2, 2)]
    assert summary.agg(F.sum("bytes")).first()[0] == 5_737_455_170_968
    files = markers.marker_files(found).withColumn("bytes", F.lit(1))
    assert rows(audit.cross_shard_commits(files)) == [("2", "6", 3340)]
    assert rows(audit.job_id_collisions(files)) == [("job_20210227000529_0000", 2), ("job_20210227020013_0000", 2)]
    broken = audit.shard_completeness(files, list(SHARDS)).where("not complete")
    assert rows(broken, "path_shard", "parts", "missing") == [("2", 1660, 3340), ("6", 3342, 1658)]
    lost = audit.missing_parts(files, list(SHARDS))
    assert rows(lost.groupBy("path_shard").count()) == [("2", 3340), ("6", 1658)]
    assert files.where("codec <> 'gz'").count() == 0 and files.count() == 80_002
    found.unpersist()
