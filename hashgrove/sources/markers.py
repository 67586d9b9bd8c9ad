"""Success markers of committed jobs: listing, reading and the tables inside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashgrove.operators.keyed import left_join

# The fields of a marker document.
MARKER_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("committer", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.LongType())),
        T.StructField("diagnostics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("filenames", T.ArrayType(T.StringType())),
    ]
)
# Fixed values: <dataset>/<shard>/<yyyyMMdd>/part-r-<part>-job_<job id>.<codec>; our own sink puts -<attempt> behind the job
FILE_PATTERN = r"/([^/]+)/(\d{8})/part-[a-z]-(\d+)-(job_[0-9]+_[0-9]+)(?:-[0-9]+)?\.([a-z0-9]+)$"
PLACE_PATTERN = r"/([^/]+)/(\d{8})/_SUCCESS$"
# the same for folders <dataset>/date=<yyyy-MM-dd>/
DATED_PATTERN = r"/([^/]+)/(?:date=)?([0-9-]+)/_SUCCESS$"
ATTEMPT_PATTERN = r"attempt_(\d{14})_"


def list_markers(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths matching a glob pattern; Spark's own readers skip names that start with ``_``.

    There is one marker per shard and day, so the listing stays small.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    paths = [(status.getPath().toString(),) for status in found or []]
    return spark.createDataFrame(paths, "path string")


def readable_uri(path: str) -> str:
    """A Hadoop path as a URI that Arrow's file systems read: file:/x has too few slashes, s3a and s3n are s3."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        return f"file://{rest}"
    return f"s3{colon}{rest}" if scheme in ("s3a", "s3n") else path


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            uri = readable_uri(path)
            system, name = fs.FileSystem.from_uri(uri)
            with system.open_input_file(name) as stream:
                text = stream.read().decode("utf-8")
            yield pd.DataFrame({"path": [path], "text": [text]})


def read_markers(spark: SparkSession, pattern: str) -> DataFrame:
    """Marker documents with the shard and day of the folder they lie in."""
    texts = list_markers(spark, pattern).mapInPandas(_read_files, "path string, text string")
    parsed = texts.select("path", F.from_json("text", MARKER_SCHEMA).alias("m"))
    return parsed.select(
        "path",
        F.regexp_extract("path", PLACE_PATTERN, 1).alias("shard"),
        F.regexp_extract("path", PLACE_PATTERN, 2).alias("day"),
        "m.*",
    )


def parse_file_names(df: DataFrame, name: str = "filename") -> DataFrame:
    """Shard, day, part number, job id and codec from a committed file's name."""
    path = F.col(name)
    return df.select(
        "*",
        F.regexp_extract(path, FILE_PATTERN, 1).alias("path_shard"),
        F.regexp_extract(path, FILE_PATTERN, 2).alias("path_day"),
        F.expr(f"try_cast(regexp_extract(`{name}`, r'{FILE_PATTERN}', 3) as int)").alias("part_no"),
        F.regexp_extract(path, FILE_PATTERN, 4).alias("job_id"),
        F.regexp_extract(path, FILE_PATTERN, 5).alias("codec"),
    )


def marker_files(markers: DataFrame) -> DataFrame:
    """One row per file a marker lists."""
    files = markers.select(
        F.col("shard").alias("committed_by"), F.explode("filenames").alias("filename")
    )
    return parse_file_names(files)


def marker_metrics(markers: DataFrame) -> DataFrame:
    """One row per metric of a marker."""
    return markers.select("shard", F.explode("metrics").alias("metric", "value"))


def with_commit_window(
    df: DataFrame, finished_ms: str = "timestamp", description: str = "description"
) -> DataFrame:
    """Add start (from the attempt named in the description), end and seconds between."""
    text = F.nullif(F.regexp_extract(F.col(description), ATTEMPT_PATTERN, 1), F.lit(""))
    # attempts are named in UTC, whatever the session's time zone
    started = F.try_to_timestamp(F.concat(text, F.lit("+0000")), F.lit("yyyyMMddHHmmssZ"))
    finished = F.timestamp_millis(F.col(finished_ms))
    return df.withColumns(
        {
            "started": started,
            "finished": finished,
            "elapsed_s": F.round(F.col(finished_ms) / 1000 - F.unix_timestamp(started)).cast("bigint"),
        }
    )


def marker_summary(markers: DataFrame) -> DataFrame:
    """Per marker: declared and listed files, bytes and commit window."""
    windows = with_commit_window(markers)
    return windows.select(
        F.col("shard").alias("committed_by"),
        F.col("metrics")["committer_commits_completed"].alias("declared"),
        F.size("filenames").cast("bigint").alias("listed"),
        F.col("metrics")["committer_bytes_committed"].alias("bytes"),
        "started",
        "finished",
        "elapsed_s",
    )


def listed_inputs(spark: SparkSession, pattern: str) -> DataFrame:
    """(input, day) of each success marker that matches a glob pattern."""
    return list_markers(spark, pattern).select(
        F.regexp_extract("path", DATED_PATTERN, 1).alias("input"),
        F.replace(F.regexp_extract("path", DATED_PATTERN, 2), F.lit("-"), F.lit("")).alias("day"),
    )


def input_readiness(required: DataFrame, listed: DataFrame, by: str = "job") -> DataFrame:
    """Per job: whether every required input has its marker, and how many lack it.

    ``required`` has (job, input, day), ``listed`` the (input, day) pairs whose marker exists.
    """
    there = listed.groupBy("input", "day").agg((F.count(F.lit(1)) > 0).alias("_there"))
    inputs = left_join(required, there, ["input", "day"])
    return inputs.groupBy(by).agg(
        F.bool_and(F.col("_there").isNotNull()).alias("ready"),
        F.count_if(F.col("_there").isNull()).alias("missing"),
    )
