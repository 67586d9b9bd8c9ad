"""Daily snapshots in buckets by key: a day's merge shuffles the feeds and leaves the snapshot where it is.

A day's folder has two parts. ``hot=false`` holds the rows in buckets by a hash of the key, as Spark's bucketed tables lay them out, so a join
by the key needs no exchange on this side. ``hot=true`` holds what no bucket should: rows without a key and rows of keys with more than ``HOT`` rows.
Those are joined the plain way, where adaptive execution splits a hot key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashgrove.operators.identity import merge_identities, merge_parts
from hashgrove.session import materialize
from hashgrove.sources.dated import day_folder

BUCKETS = 64
HOT = 100_000
MARK = "hot"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_bucketed(df: DataFrame, folder: str, key: str, buckets: int = BUCKETS, hot: int = HOT) -> None:
    """Write ``df`` to a day's folder, replacing it: rows of a key with more than ``hot`` rows, and rows without one, beside the buckets.

    Rows that lie in as many partitions by the key already, as after a join with a snapshot, are not exchanged again.
    """
    keyed = df.where(F.col(key).isNotNull())
    marked = keyed.withColumn(MARK, F.count(F.lit(1)).over(Window.partitionBy(key)) > hot)
    nameless = df.where(F.col(key).isNull()).withColumn(MARK, F.lit(True))
    _save(marked.unionByName(nameless), folder, key, buckets)


def _save(marked: DataFrame, folder: str, key: str, buckets: int) -> None:
    name = f"snapshot_{uuid.uuid4().hex}"
    writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "static").option("path", folder).partitionBy(MARK)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    # the files stay: the table lies outside the warehouse
    marked.sparkSession.sql(f"DROP TABLE {name}")


@contextmanager
def bucketed(spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> Iterator[DataFrame]:
    """The rows in buckets of a day's folder, as a table that the planner knows the buckets of."""
    name = f"snapshot_{uuid.uuid4().hex}"
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({_quoted(key)}) INTO {buckets} BUCKETS LOCATION '{folder}/{MARK}=false'")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def beside(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows beside the buckets of a day's folder."""
    part = f"{folder}/{MARK}=true"
    return spark.read.schema(schema).parquet(part) if _exists(spark, part) else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of a day's folder; without a ``schema`` it is that of the files, of which an empty day has none."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(folder).drop(MARK)


def merge_day(
    spark: SparkSession,
    root: str,
    day: date,
    delta: DataFrame,
    oracle: DataFrame,
    key: str = "email_hash",
    buckets: int = BUCKETS,
    hot: int = HOT,
) -> None:
    """Write ``day``'s identity snapshot from the day before's and the two feeds, with the results of ``merge_identities``.

    The feeds are split into keys that are hot on either side and the rest. For the rest, delta and oracle rows are brought to the snapshot's
    buckets. Each of the three parts of the merge has its keys to itself, and the written day keeps the buckets.
    """
    before, after = day_folder(root, day - timedelta(days=1)), day_folder(root, day)
    schema = T.StructType([oracle.schema[key], delta.schema["idl"], oracle.schema["oracle_id"]])
    plain = beside(spark, before, schema)
    newest = materialize(delta.groupBy(key).agg(F.max("idl").alias("idl")), "delta")
    crowded = oracle.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(key)
    keys = materialize(plain.where(F.col(key).isNotNull()).select(key).union(crowded).distinct(), "hot-keys")

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of hot keys, and those without a key."""
        return rows.join(keys, key, "left_semi").unionByName(rows.where(F.col(key).isNull()))

    def rest(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).join(keys, key, "left_anti")

    with bucketed(spark, before, schema, key, buckets) as current:
        moved = current.join(keys, key, "left_semi").select(*schema.names)
        aside = merge_identities(plain.unionByName(moved), apart(newest), apart(oracle), key)
        kept, *new = (part.select(*schema.names) for part in merge_parts(rest(current), rest(newest), rest(oracle), key))
        # rows of one key may multiply in the first part only
        marked = kept.withColumn(MARK, F.count(F.lit(1)).over(Window.partitionBy(key)) > hot)
        for part in new:
            marked = marked.unionByName(part.withColumn(MARK, F.lit(False)))
        _save(marked.unionByName(aside.select(*schema.names).withColumn(MARK, F.lit(True))), after, key, buckets)


def merge_state(spark: SparkSession, root: str, day: date, rows: DataFrame, key: str, least: str, greatest: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``day``'s state of one row per key from the day before's and the day's ``rows``; return the state.

    ``rows`` has (key, least, greatest), each key once and not null; a key's state has the least and the greatest of all
    days. Without a state of the day before, it begins with ``rows``. Only the rows are brought to the buckets.
    """
    before, after = day_folder(root, day - timedelta(days=1)), day_folder(root, day)
    new = materialize(rows.select(key, F.col(least).alias("_least"), F.col(greatest).alias("_greatest")), "state")
    first = new.select(key, F.col("_least").alias(least), F.col("_greatest").alias(greatest))
    schema = first.schema
    if not _exists(spark, before):
        _save(first.withColumn(MARK, F.lit(False)), after, key, buckets)
        return read_snapshot(spark, after, schema)
    with bucketed(spark, before, schema, key, buckets) as state:
        known = state.join(new, key, "left").select(key, F.least(least, "_least").alias(least), F.greatest(greatest, "_greatest").alias(greatest))
        unknown = first.join(state.select(key), key, "left_anti")
        _save(known.unionByName(unknown).withColumn(MARK, F.lit(False)), after, key, buckets)
    return read_snapshot(spark, after, schema)
