"""Daily merge of an identity snapshot with two partner feeds."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.functions.text import filled
from hashgrove.session import materialize
from hashgrove.sources.dated import day_folder, read_day


def feed_interval(
    days: tuple[date, date], whole_interval: bool = False, partner_interval: bool = False
) -> tuple[date, date]:
    """Days of a partner feed to read: the job's interval if asked for, else the day before its last."""
    if whole_interval or partner_interval:
        return days
    before = days[1] - timedelta(days=1)
    return before, before


def expand_raw(df: DataFrame, raw: str, value: str, separator: str = ";") -> DataFrame:
    """Turn each raw partner row into one row per non-blank value of its ``raw`` list.

    ``pos`` is the value's place in the list.
    """
    parts = F.split(F.col(raw), separator)
    return (
        df.select("*", F.posexplode(F.transform(parts, lambda v: F.trim(v))).alias("pos", value))
        .where(F.col(value) != "")
        .drop(raw)
    )


def reduce_delta(
    df: DataFrame,
    key: str = "email_hash",
    value: str = "idl",
    order: tuple[str, ...] = ("seq", "pos"),
) -> DataFrame:
    """Newest non-empty value per key."""
    newest = F.max_by(value, F.struct(*order)).alias(value)
    return df.where(F.col(value) != "").groupBy(key).agg(newest)


def merge_parts(current: DataFrame, delta: DataFrame, oracle: DataFrame, key: str = "email_hash") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three parts of ``merge_identities``; no key is in two of them, and the first stays partitioned as ``current`` is."""
    c = current.select(
        key, F.col("idl").alias("_idl"), F.col("oracle_id").alias("_oracle_id"), F.lit(True).alias("_c")
    )
    d = delta.groupBy(key).agg(F.max("idl").alias("idl")).withColumn("_d", F.lit(True))
    d = materialize(d, "delta")
    o = oracle.select(key, "oracle_id", F.lit(True).alias("_o"))
    c_keys, o_keys = c.select(key), o.select(key)
    parts = (
        c.join(d, key, "left").join(o, key, "left"),
        o.join(c_keys, key, "left_anti").join(d, key, "left"),
        d.join(c_keys, key, "left_anti").join(o_keys, key, "left_anti"),
    )

    def finished(part: DataFrame) -> DataFrame:
        absent = {"_c": "boolean", "_d": "boolean", "_o": "boolean", "idl": "string", "oracle_id": "string", "_idl": "string", "_oracle_id": "string"}
        part = part.withColumns({n: F.lit(None).cast(kind) for n, kind in absent.items() if n not in part.columns})
        presence = F.concat_ws(
            "+",
            F.when(F.col("_c"), "current"),
            F.when(F.col("_d"), "delta"),
            F.when(F.col("_o"), "oracle"),
        )
        return part.select(
            key,
            F.coalesce(filled(F.col("idl")), F.col("_idl")).alias("idl"),
            F.coalesce(filled(F.col("oracle_id")), F.col("_oracle_id")).alias("oracle_id"),
            F.when(presence == "", F.raise_error(F.lit("a merged row has no side")))
            .otherwise(presence)
            .alias("presence"),
        )

    return tuple(map(finished, parts))


def merge_identities(
    current: DataFrame, delta: DataFrame, oracle: DataFrame, key: str = "email_hash"
) -> DataFrame:
    """Outer merge of the snapshot, the reduced delta and the second partner's ids.

    The newest non-empty value wins per field: the delta supplies ``idl``, the oracle side
    ``oracle_id``. Repeated keys of the snapshot or oracle side multiply; null equals no key.
    ``presence`` names the sides that had the key.

    Repeated keys of ``delta`` are reduced to the greatest ``idl``. Instead of a full outer join, whose hot keys no plan can
    split, there are three parts: rows of the snapshot with what both others have, rows of the oracle side that
    the snapshot lacks with the delta's values, and rows of the delta alone. All are left and anti joins of scanned or
    written tables, which adaptive execution splits, also where many rows have no key.
    """
    return reduce(DataFrame.unionByName, merge_parts(current, delta, oracle, key))


def update_snapshot(
    spark: SparkSession,
    root: str,
    day: date,
    delta: DataFrame,
    oracle: DataFrame,
    key: str = "email_hash",
) -> None:
    """Write ``day``'s snapshot below ``root`` from the day before's and the two feeds.

    Only ``day``'s folder is replaced, never the one the job reads.
    """
    current = read_day(spark, root, day - timedelta(days=1))
    merged = merge_identities(current, delta, oracle, key).drop("presence")
    merged.write.mode("overwrite").parquet(day_folder(root, day))
