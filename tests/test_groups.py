from __future__ import annotations

import math
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hashgrove.operators import groups, impressions
from helpers import rows

FOUR = [(1, None, None, 1.0), (2, None, "h", 2.0), (3, 7, None, 4.0), (4, 7, "h", 8.0)]
SCHEMA = "id int, bidder_id int, email_hash string, v double"
GROUPS_OF = {
    1: {("ALL", "NO-HASH"), ("ALL", "ALL")},
    2: {("ALL", "OUTSIDE-GROUPS"), ("ALL", "ALL")},
    3: {("ALL", "NO-HASH"), ("ALL", "ALL"), ("ALL-RTB", "NO-HASH"), ("ALL-RTB", "ALL"),
        ("7", "NO-HASH"), ("7", "UNKNOWN-BIDDER"), ("7", "ALL")},
    4: {("ALL", "OUTSIDE-GROUPS"), ("ALL", "ALL"), ("ALL-RTB", "OUTSIDE-GROUPS"),
        ("ALL-RTB", "ALL"), ("7", "UNKNOWN-BIDDER"), ("7", "ALL")},
}


@pytest.fixture
def four(spark):
    return spark.createDataFrame(FOUR, SCHEMA)


def fan(df, **options):
    return groups.fan_out_groups(df, F.col("bidder_id"), F.col("email_hash"), **options)


def test_fan_out(four):
    expected = sorted(((i, b, g) for i, pairs in GROUPS_OF.items() for b, g in pairs), key=repr)
    assert rows(fan(four), "id", "bidder", "grp") == expected


def test_fan_out_literal_repeats_the_bidder_total(four):
    found = rows(fan(four, dedupe_keys=False).where("id = 3"), "bidder", "grp")
    assert found.count(("7", "ALL")) == 2 and len(found) == 8


@pytest.mark.parametrize(
    ("options", "gone"),
    [({"no_all": True}, {"ALL"}), ({"no_all_rtb": True}, {"ALL-RTB"}),
     ({"no_all": True, "no_all_rtb": True}, {"ALL", "ALL-RTB"})],
)
def test_fan_out_exclusions(four, options, gone):
    bidders = {b for _, b, _ in rows(fan(four, **options), "id", "bidder", "grp")}
    assert bidders == {"ALL", "ALL-RTB", "7"} - gone


@pytest.fixture(scope="module")
def many(spark):
    """Rows with nulls, several bidders and categories with more values than are kept."""
    i = F.col("id")
    return spark.range(4000).select(
        i,
        F.when(i % 4 != 0, (i % 3).cast("int")).alias("bidder_id"),
        F.when(i % 5 != 0, F.concat(F.lit("h"), i.cast("string"))).alias("email_hash"),
        F.when(i % 6 != 0, 1e6 + F.sin(i)).alias("v"),
        F.when(i % 7 != 0, (i * i % 97).cast("string")).alias("c"),
    )


def measures():
    return {
        "moments": {"v": F.col("v")},
        "sums": {"flag": F.when(F.col("bidder_id").isNotNull(), 1)},
        "categories": {"c": F.col("c")},
    }


@pytest.fixture(scope="module")
def by_cells(many):
    return groups.bidder_statistics(many, F.col("bidder_id"), F.col("email_hash"), **measures())


def test_cell_form_equals_row_form(many, by_cells):
    by_rows = groups.group_aggregates(fan(many), **measures())
    assert rows(by_cells.sums) == rows(by_rows.sums)
    assert rows(by_cells.categories) == rows(by_rows.categories)
    a, b = rows(by_cells.moments), rows(by_rows.moments)
    assert [r[:4] for r in a] == [r[:4] for r in b]
    for x, y in zip(a, b):
        assert math.isclose(x[4], y[4], rel_tol=1e-12) and math.isclose(x[5], y[5], rel_tol=1e-6)


def test_literal_form_equals_row_form(many):
    options = {"dedupe_keys": False}
    cells = groups.bidder_statistics(many, F.col("bidder_id"), F.col("email_hash"), **measures(), **options)
    by_rows = groups.group_aggregates(fan(many, **options), **measures())
    assert rows(cells.sums) == rows(by_rows.sums)
    assert [r[:4] for r in rows(cells.moments)] == [r[:4] for r in rows(by_rows.moments)]


def test_lazy_form(many, by_cells):
    lazy = groups.bidder_statistics(
        many, F.col("bidder_id"), F.col("email_hash"), **measures(), written=False
    )
    assert rows(lazy.sums) == rows(by_cells.sums)


def test_moments_of_one_group(many, by_cells):
    values = [r.v for r in fan(many).where("bidder = '1' and grp = 'ALL' and v is not null").collect()]
    found = groups.mean_statistic(by_cells, "v").where("bidder = '1' and grp = 'ALL'").first()
    assert found.n == len(values)
    assert math.isclose(found.mean, statistics.fmean(values), rel_tol=1e-12)
    assert math.isclose(found.stddev, statistics.pstdev(values), rel_tol=1e-6)


def test_top_values(many, by_cells):
    counts: dict[str, int] = {}
    for r in many.where("c is not null").collect():
        counts[r.c] = counts.get(r.c, 0) + 1
    top = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[: groups.TOP_VALUES]
    found = by_cells.categories.where("bidder = 'ALL' and grp = 'ALL'")
    assert rows(found, "value", "n") == sorted(top, key=repr)


def test_one_row_group_has_no_spread(four):
    stats = groups.bidder_statistics(four, F.col("bidder_id"), F.col("email_hash"), moments={"v": F.col("v")})
    found = groups.mean_statistic(stats, "v").where("bidder = '7' and grp = 'NO-HASH'").first()
    assert (found.n, found.mean, found.stddev) == (1, 4.0, 0.0)


def test_empty_groups_are_dropped(spark):
    df = spark.createDataFrame([("b", "", 1.0), ("b", "g", 2.0)], "bidder string, grp string, v double")
    stats = groups.group_aggregates(df, moments={"v": F.col("v")})
    assert rows(stats.moments, "bidder", "grp", "n") == [("b", "g", 1)]


def test_proportion_and_category_statistics(four):
    stats = groups.bidder_statistics(
        four, F.col("bidder_id"), F.col("email_hash"), moments={"v": F.col("v")},
        sums={"flag": F.when(F.col("bidder_id").isNotNull(), 1)}, categories={"k": F.lit("x")},
    )
    whole = "bidder = 'ALL' and grp = 'ALL'"
    assert rows(groups.proportion_statistic(stats, "flag", "v").where(whole), "hits", "total") == [(2, 4)]
    assert rows(groups.proportion_statistic(stats, "absent", "v").where(whole), "hits", "total") == [(0, 4)]
    assert rows(groups.proportion_statistic(stats, "flag", "absent")) == []
    assert rows(groups.category_statistic(stats, "k", "v").where(whole), "value", "n", "total") == [("x", 4, 4)]
    assert rows(groups.category_statistic(stats, "absent", "v")) == []


def test_union_disjoint(four):
    a = groups.group_aggregates(fan(four), moments={"v": F.col("v")})
    b = groups.group_aggregates(fan(four), moments={"w": F.col("v") * 2})
    united = groups.union_disjoint(a, b)
    assert {r.measure for r in united.moments.collect()} == {"v", "w"}
    with pytest.raises(PySparkException, match="on both sides"):
        groups.union_disjoint(a, a).moments.collect()


def test_rest_is_the_complement(four):
    stats = groups.bidder_statistics(four, F.col("bidder_id"), F.col("email_hash"), moments={"v": F.col("v")})
    found = groups.compare_with_rest(stats).where("bidder = 'ALL' and grp = 'NO-HASH'").first()
    # own rows 1, 4; the rest 2, 8
    assert math.isclose(found["diff"], 2.5 - 5.0)
    assert math.isclose(found["z"], -2.5 / math.sqrt(2.25 / 2 + 9.0 / 2))
    # a group that is all of its bidder has no rest
    assert rows(groups.compare_with_rest(stats).where("grp = 'UNKNOWN-BIDDER'")) == []


def test_pairs(four):
    stats = groups.bidder_statistics(four, F.col("bidder_id"), F.col("email_hash"), moments={"v": F.col("v")})
    pairs = rows(groups.compare_groups(stats.moments), "bidder", "grp_a", "grp_b")
    assert len(pairs) == len(set(pairs)) == 3 * (3 * 2)
    assert all(a != b for _, a, b in pairs)


def test_order_by_group(spark):
    df = spark.createDataFrame([("b", "x"), ("ALL", "z"), ("b", "A"), ("b!", "x")], "bidder string, grp string")
    found = [tuple(r) for r in groups.order_by_group(df).collect()]
    assert found == sorted(found, key=lambda r: f"{r[0]}#{r[1]}")


def test_report_has_nulls_for_absent_measures(spark):
    from hashgrove.sources.views import read_view

    rows_ = impressions.dedupe_impressions(read_view(spark, "/root/testdata/sf0.001", "impressions"))
    report = groups.group_report(groups.impression_statistics(rows_), "2024-01-30")
    for r in report.collect():
        assert r.bids is None and r.nonZeroBids is None and r.largeBids is None
        assert r.responses is None and r.idaasIndices is None
        assert r.clicks["count"] == 0 and r.clicks["total"] == r.spend["n"]
        assert (r.sources is None) == (r.definition.bidder != "ALL")
        assert sum(r.pricingTypes.frequencies.values()) == r.pricingTypes.total == r.spend["n"]
        assert r.definition.label == "NO-LABEL" and r.definition.description == "NO-DESCRIPTION"
