"""Dated datasets: one folder per day, read by interval, written without touching other days."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.operators.keyed import clustered

DAY = "date"
MARKER = "_SUCCESS"


def day_folder(root: str, day: date) -> str:
    return f"{root.rstrip('/')}/{DAY}={day.isoformat()}"


def read_dated(spark: SparkSession, root: str, first: date, last: date) -> DataFrame:
    """Rows of the days from ``first`` to ``last``; other days' folders are not read."""
    days = spark.read.parquet(root)
    return days.where(F.col(DAY).between(F.lit(first), F.lit(last)))


def read_day(spark: SparkSession, root: str, day: date) -> DataFrame:
    """Rows of one day, from its folder alone, so that later days may be written meanwhile."""
    return spark.read.parquet(day_folder(root, day))


def head_of_days(df: DataFrame, first: date, last: date) -> DataFrame:
    """The first day with rows from ``first`` to ``last``, as one row; none if there is no such day."""
    inside = df.where(F.col(DAY).between(F.lit(first), F.lit(last)))
    return inside.agg(F.min(DAY).alias(DAY)).where(F.col(DAY).isNotNull())


def mark_complete(spark: SparkSession, root: str, days: Iterable[date]) -> None:
    """Put an empty success marker into each day's folder, for readers that wait for it."""
    jvm = spark._jvm
    for day in days:
        path = jvm.org.apache.hadoop.fs.Path(f"{day_folder(root, day)}/{MARKER}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()


FILES_PER_DAY = 64


def write_dated(df: DataFrame, root: str, days: Iterable[date] = (), files_per_day: int = FILES_PER_DAY) -> None:
    """Replace the days that occur in ``df``'s ``date`` column and keep all others.

    A day gets at most ``files_per_day`` files, however many tasks hold its rows, and they are alike in size. ``days`` get a
    success marker afterwards: a write of several days leaves none of its own.
    """
    (
        clustered(df, DAY, files_per_day).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(root)
    )
    mark_complete(df.sparkSession, root, days)
