"""Removal of scraper traffic from tracking events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.session import materialize


def _has_both(first_party: str, third_party: str) -> Column:
    return (F.col(first_party) != "") & (F.col(third_party) != "")


def scraper_ids(
    df: DataFrame, first_party: str = "first_party_id", third_party: str = "third_party_id"
) -> DataFrame:
    """First-party cookies seen with two or more different third-party ids, and how many."""
    return (
        df.where(_has_both(first_party, third_party))
        .groupBy(first_party)
        .agg(F.count_distinct(third_party).alias("n_ids"))
        .where("n_ids > 1")
    )


def remove_scrapers(
    df: DataFrame, first_party: str = "first_party_id", third_party: str = "third_party_id"
) -> DataFrame:
    """Drop every row of a scraper's first-party cookie; rows without a cookie stay and are not shuffled."""
    # two different ids exist exactly if the smallest and the largest differ
    ids = F.when(F.col(third_party) != "", F.col(third_party))
    has_cookie = F.coalesce(F.col(first_party) != "", F.lit(False))
    seen = df.where(has_cookie & ids.isNotNull()).groupBy(first_party).agg(F.min(ids).alias("_a"), F.max(ids).alias("_b"))
    scrapers = materialize(seen.where("_a <> _b").select(first_party), "scrapers")
    return remove_known(df, scrapers, first_party)


def day_ids(df: DataFrame, first_party: str = "first_party_id", third_party: str = "third_party_id") -> DataFrame:
    """Rows (first_party, least, greatest): the least and greatest third-party id seen with each first-party cookie."""
    rows = df.where(_has_both(first_party, third_party)).groupBy(first_party)
    return rows.agg(F.min(third_party).alias("least"), F.max(third_party).alias("greatest"))


def known_scrapers(state: DataFrame, first_party: str = "first_party_id") -> DataFrame:
    """Cookies of a state (first_party, least, greatest) that were seen with two or more ids, on whichever days."""
    return state.where("least <> greatest").select(first_party)


def remove_known(df: DataFrame, scrapers: DataFrame, first_party: str = "first_party_id") -> DataFrame:
    """``df`` without the rows of ``scrapers``, a written table; rows without a cookie stay and are not shuffled."""
    has_cookie = F.coalesce(F.col(first_party) != "", F.lit(False))
    return df.where(has_cookie).join(scrapers, first_party, "left_anti").select(df.columns).unionByName(df.where(~has_cookie))
