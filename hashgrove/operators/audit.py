"""Completeness checks of sharded daily output, retention and volume checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.sources.sharded import FILES_PER_SHARD

# --- committed files: committed_by, path_shard, part_no, job_id ----------------------------------


def _shards(files: DataFrame, expected_shards: Sequence) -> DataFrame:
    """The shards that a day must have, a small list; a shard without any file is found by it alone."""
    kind = files.schema["path_shard"].dataType.simpleString()
    wanted = F.array(*map(F.lit, expected_shards)).cast(f"array<{kind}>")
    return files.sparkSession.range(1).select(F.explode(wanted).alias("path_shard"))


def shard_completeness(files: DataFrame, expected_shards: Sequence, expected: int = FILES_PER_SHARD) -> DataFrame:
    """Files, bytes, distinct parts and missing parts of each expected shard against the expected number.

    A shard that has files but is not expected is reported too.
    """
    found = files.groupBy("path_shard").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("part_no").alias("parts")
    )
    # both sides have one row per shard
    return (
        _shards(files, expected_shards)
        .join(found, "path_shard", "full")
        .na.fill(0, ["files", "bytes", "parts"])
        .withColumn("missing", F.lit(expected) - F.col("parts"))
        .withColumn("complete", F.col("missing") == 0)
    )


def missing_parts(files: DataFrame, expected_shards: Sequence, expected: int = FILES_PER_SHARD) -> DataFrame:
    """Part numbers below ``expected`` that no file of an expected shard has; all of them for a shard without files."""
    parts = files.select("path_shard", "part_no").distinct()
    shards = _shards(files, expected_shards)
    wanted = shards.select(
        "path_shard", F.explode(F.sequence(F.lit(0), F.lit(expected - 1))).alias("part_no")
    )
    return wanted.join(parts, ["path_shard", "part_no"], "left_anti")


def cross_shard_commits(files: DataFrame) -> DataFrame:
    """Files a job committed below another shard's folder."""
    return (
        files.where("committed_by <> path_shard")
        .groupBy("committed_by", "path_shard")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def job_id_collisions(files: DataFrame) -> DataFrame:
    """Job ids used by more than one committing shard. A warning, not yet a loss."""
    return (
        files.groupBy("job_id")
        .agg(F.count_distinct("committed_by").alias("shards"))
        .where("shards > 1")
    )


def overlapping_windows(commits: DataFrame) -> DataFrame:
    """Job ids under which the commits of two shards overlapped in time.

    ``commits`` has job_id, committed_by, started and finished, and is combined per job and shard.
    """
    spans = commits.groupBy("job_id", "committed_by").agg(
        F.min("started").alias("started"), F.max("finished").alias("finished")
    )
    # a job id is shared by a handful of shards
    before = (
        Window.partitionBy("job_id")
        .orderBy("started", "committed_by")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        spans.withColumn("_busy_until", F.max("finished").over(before))
        .groupBy("job_id")
        .agg(F.count_if(F.col("started") < F.col("_busy_until")).alias("overlaps"))
        .where("overlaps > 0")
    )


def declared_against_listed(summary: DataFrame, expected: int = FILES_PER_SHARD) -> DataFrame:
    """Markers whose declared, listed and expected numbers of files are not all equal."""
    return summary.where((F.col("declared") != F.col("listed")) | (F.col("listed") != expected))


def metric_spread(metrics: DataFrame) -> DataFrame:
    """Least, greatest and mean value of each metric over all shards."""
    return metrics.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        F.avg("value").alias("mean"),
    )


# --- retention and volume ------------------------------------------------------------------------

# Days kept in full, months whose first day is kept.
KEEP_DAYS, KEEP_MONTHS = 7, 12


def is_kept(day: Column, as_of: date, days: int = KEEP_DAYS, months: int = KEEP_MONTHS) -> Column:
    """Whether a day is among the last ``days``, or first of one of the last ``months`` months."""
    today = F.lit(as_of)
    recent = day > F.date_sub(today, days)
    month_start = F.add_months(F.trunc(today, "month"), 1 - months)
    return (day <= today) & (recent | ((F.dayofmonth(day) == 1) & (day >= month_start)))


def retention_plan(df: DataFrame, day: str, as_of: date) -> DataFrame:
    """Each day of a dataset and whether to keep it."""
    return (
        df.select(F.to_date(day).alias("day"))
        .distinct()
        .withColumn("keep", is_kept(F.col("day"), as_of))
    )


def daily_volume(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Rows per entity and day."""
    return df.groupBy(F.col(entity).alias("entity"), F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


def on_calendar(volume: DataFrame, last: date | None = None) -> DataFrame:
    """``volume`` with a row of 0 for each day without rows, from an entity's first day to ``last`` (by default the last day of all)."""
    spans = volume.groupBy("entity").agg(F.min("day").alias("first"))
    end = F.lit(last) if last else volume.agg(F.max("day").alias("day")).scalar()
    days = spans.select("entity", F.explode(F.sequence("first", F.greatest("first", end))).alias("day"))
    return days.join(volume, ["entity", "day"], "left").select("entity", "day", F.coalesce("n", F.lit(0)).alias("n"))


def volume_drop(volume: DataFrame, least_ratio: float = 0.9, last: date | None = None) -> DataFrame:
    """Volume against the day before of the same entity, flagged when it fell below the ratio; a day without rows has 0."""
    volume = on_calendar(volume, last)
    by_day = Window.partitionBy("entity").orderBy("day")
    before = F.lag("n").over(by_day)
    ratio = F.when(before > 0, F.col("n") / before)
    return volume.withColumn("ratio", ratio).withColumn(
        "dropped", F.coalesce(F.col("ratio") < least_ratio, F.lit(False))
    )


def daily_anomaly(volume: DataFrame, days: int = 7, least_days: int = 3, last: date | None = None) -> DataFrame:
    """z score of a day's volume against the ``days`` before it, days without rows counting as 0; null before ``least_days`` of them."""
    volume = on_calendar(volume, last)
    before = Window.partitionBy("entity").orderBy("day").rowsBetween(-days, -1)
    mean, spread = F.avg("n").over(before), F.stddev_pop("n").over(before)
    enough = F.count("n").over(before) >= least_days
    return volume.select(
        "*", F.when(enough & (spread > 0), (F.col("n") - mean) / spread).alias("z")
    )


# --- running tasks -------------------------------------------------------------------------------

# States of a live task, the waiting operator and the guard's own task.
LIVE_STATES = ("running", "queued")
WAITING_OPERATOR = "S3KeySensor"
GUARD_TASK = "Check_running_tasks"


def running_tasks(tasks: DataFrame) -> DataFrame:
    """Live tasks per dag and date, apart from waiting ones and the guard itself."""
    return (
        tasks.where(
            F.col("state").isin(*LIVE_STATES)
            & (F.col("operator") != WAITING_OPERATOR)
            & (F.col("task_id") != GUARD_TASK)
        )
        .groupBy("dag_id", "execution_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
