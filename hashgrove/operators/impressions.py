"""Impression deduplication, quality flags and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.functions.text import (
    browser_class,
    category_default,
    device_class,
    first_filled,
    os_class,
)
from hashgrove.operators.keyed import left_join

# Defaults for missing data and labels of missing categories.
NO_DECISION, NO_ATTEMPT, NO_TEMPLATE = "", -1, -1
UNKNOWN_PRICING = "UNKNOWN-PRICINGTYPE"
UNKNOWN_DEVICE = "UNKNOWN-DEVICETYPE"
UNKNOWN_OS = "UNKNOWN-OS"
UNKNOWN_BROWSER = "UNKNOWN-BROWSER"
UNKNOWN_SOURCE = "UNKNOWN-UIDSOURCE"

FEES = ("actual_dsp_fee", "actual_pgm_fee", "actual_ssp_fee", "thirdparty_margin")
DROP_KEYS = ("hash", "template_id", "placement_id")


def dedupe_impressions(df: DataFrame) -> DataFrame:
    """First impressions, one per (decision, attempt): the one with the least (ts, impression_id).

    Missing and sentinel keys fall together. The rank filter keeps one row per key in each map
    task before the shuffle, so a hot key sends one row per task.
    """
    by_decision = Window.partitionBy(
        F.coalesce("decision_id", F.lit(NO_DECISION)),
        F.coalesce("redecision_attempt", F.lit(NO_ATTEMPT)),
    ).orderBy("ts", "impression_id")
    return (
        df.where("is_first_impression")
        .withColumn("_rank", F.row_number().over(by_decision))
        .where("_rank = 1")
        .drop("_rank")
    )


def drop_keys() -> list[Column]:
    """The key by which broken drops spread to other impressions."""
    return [
        first_filled(F.col("md5"), F.col("sh1"), F.col("sh2")).alias("hash"),
        F.coalesce("template_id", F.lit(NO_TEMPLATE)).alias("template_id"),
        F.col("placement_id"),
    ]


def broken_drop_keys(df: DataFrame) -> DataFrame:
    """Distinct keys of impressions flagged as broken drops."""
    return df.where("is_broken_drop").select(*drop_keys()).distinct()


def flag_broken_drops(df: DataFrame) -> DataFrame:
    """Set ``is_broken_drop`` on every impression that shares its key with a broken drop."""
    names = [f"_{n}" for n in DROP_KEYS]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(drop_keys(), names)])
    broken = broken_drop_keys(df).toDF(*names).withColumn("_broken", F.lit(True))
    marked = left_join(keyed, broken, names, null_safe=True)
    return marked.withColumn("is_broken_drop", F.expr("is_broken_drop or coalesce(_broken, false)")).drop(*names, "_broken")


def expected_profit() -> Column:
    """Sum of the four optional fees, a missing one counting as zero."""
    total = F.lit(0.0)
    for fee in FEES:
        total = total + F.coalesce(F.col(fee), F.lit(0.0))
    return total


def device_category(agent: Column) -> Column:
    return device_class(agent, UNKNOWN_DEVICE)


def os_category(agent: Column) -> Column:
    return os_class(agent, UNKNOWN_OS)


def browser_category(agent: Column) -> Column:
    return browser_class(agent, UNKNOWN_BROWSER)


def pricing_category(pricing_type: Column) -> Column:
    return category_default(pricing_type, UNKNOWN_PRICING)


def source_category(source: Column) -> Column:
    return category_default(source, UNKNOWN_SOURCE)


def ua_classes(df: DataFrame) -> DataFrame:
    """Device, OS and browser category of each impression."""
    agent = F.col("user_agent")
    return df.select(
        "impression_id",
        device_category(agent).alias("device"),
        os_category(agent).alias("os"),
        browser_category(agent).alias("browser"),
    )
