"""Daily output split into shards of many files each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.functions.text import hex_shard
from hashgrove.operators.keyed import place_of

# Fixed value: files per shard of a normal day.
FILES_PER_SHARD = 5000


def with_shard(df: DataFrame, key: str, shard: str = "shard") -> DataFrame:
    return df.withColumn(shard, hex_shard(F.col(key)))


def write_sharded(
    df: DataFrame,
    root: str,
    key: str,
    tasks: int,
    files_per_shard: int = FILES_PER_SHARD,
    date: str = "date",
) -> None:
    """Write ``root/shard=<x>/date=<d>/`` with about equal files, at most ``files_per_shard`` a day.

    Rows are dealt by a hash of the whole row, so neither a large shard nor a hot key grows one file.
    """
    part = place_of(df, files_per_shard).alias("_part")
    rows = with_shard(df.select("*", part), key)
    (
        rows.repartition(tasks, "shard", date, "_part")
        .drop("_part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard", date)
        .parquet(root)
    )
