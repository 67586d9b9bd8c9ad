from __future__ import annotations

import random

import pytest

from hashgrove.operators import licensing
from hashgrove.plans.catalog import QUERIES
from hashgrove.sources.views import read_view
from helpers import rows


@pytest.fixture(scope="module")
def info(spark):
    data = [("a", 1, 10, 100), ("b", 2, 20, 200), ("c", 4, 40, 400), ("d", 8, 80, 800), ("d", 16, 0, 0), (None, 99, 9, 9)]
    return spark.createDataFrame(data, "identifier string, opens int, clicks int, conversions int")


@pytest.fixture(scope="module")
def licenses(spark):
    data = [
        ("a", "AudienceAcuityMain"), ("a", "AudienceAcuityPair"), ("a", "LiveRampPelFile"),
        ("b", "TowerData"), ("b", "TowerData"), ("c", "Mystery"), ("nobody", "TowerData"), (None, "TowerData"),
    ]
    return spark.createDataFrame(data, "identifier string, license string")


def test_totals_count_an_identifier_once_per_partner(info, licenses):
    assert rows(licensing.partner_totals(info, licenses)) == [
        ("Audience Accuity", 1, 1, 10, 100), ("LiveRamp", 1, 1, 10, 100), ("TowerData", 1, 2, 20, 200)
    ]


def test_overlap_keeps_the_uncovered(info, licenses):
    assert rows(licensing.partner_overlap(info, licenses), "partners", "identifiers", "opens") == [
        ("", 2, 28), ("Audience Accuity+LiveRamp", 1, 1), ("TowerData", 1, 2)
    ]


def test_coverage_of_all_choices(info, licenses):
    found = {r.subset: (r.identifiers, r.opens) for r in licensing.partner_coverage(info, licenses).collect()}
    assert len(found) == 7
    assert found["Audience Accuity+LiveRamp"] == (1, 1)
    assert found["LiveRamp+TowerData"] == (2, 3)
    assert found["Audience Accuity+LiveRamp+TowerData"] == (2, 3)


def test_lift_against_the_current_partner(info, licenses):
    found = {r.subset: r for r in licensing.partner_lift(info, licenses).collect()}
    assert found["LiveRamp"].opens_change == 0
    assert found["TowerData"].opens_change == 1
    assert found["TowerData"].opens_share == pytest.approx(2 / 31)


def test_unlicensed_and_unmapped(info, licenses):
    assert rows(licensing.unlicensed(info, licenses)) == [("d",)]
    assert rows(licensing.unmapped_codes(licenses)) == [("Mystery", 1)]


def test_licence_queries_read_every_event(spark, tmp_path):
    # the view once left user 23 out
    data = [(0, 23, "view"), (1, 23, "click"), (2, 44, "view")]
    found = [(e, u, k, f"2024-01-0{e + 1} 00:00:00", float(e)) for e, u, k in data]
    spark.createDataFrame(found, "event_id bigint, user_id bigint, event_type string, ts string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert read_view(spark, str(tmp_path), "license_info").count() == len(data)
    assert rows(QUERIES["partner_totals"](spark, str(tmp_path)), "partner", "identifiers", "opens", "clicks") == [("Audience Accuity", 0, 0, 0), ("LiveRamp", 0, 0, 0), ("TowerData", 1, 1, 1)]
    assert rows(QUERIES["partner_overlap"](spark, str(tmp_path)), "partners", "identifiers") == [("", 1), ("TowerData", 1)]
    assert {r["subset"]: r["identifiers"] for r in QUERIES["partner_coverage"](spark, str(tmp_path)).collect()}["LiveRamp+TowerData"] == 1
    assert {r["subset"]: r["opens_share"] for r in QUERIES["partner_lift"](spark, str(tmp_path)).collect()}["TowerData"] == 0.5
    assert rows(QUERIES["unmapped_codes"](spark, str(tmp_path))) == [("UnknownFile", 2)]


def test_choices_among_twelve_partners(spark):
    rng = random.Random(2)
    partner_of = {f"c{i}": f"P{i:02d}" for i in range(12)}
    info = [(f"i{k}", rng.randint(0, 9), 1, 0) for k in range(400)]
    owned = [(f"i{rng.randrange(450)}", f"c{rng.randrange(13)}") for _ in range(1500)]
    frames = spark.createDataFrame(info, "identifier string, opens int, clicks int, conversions int"), spark.createDataFrame(owned, "identifier string, license string")
    partners = {i: {partner_of[c] for j, c in owned if j == i and c in partner_of} for i, *_ in info}
    found = {r["subset"]: (r["identifiers"], r["opens"], r["clicks"], r["conversions"]) for r in licensing.partner_coverage(*frames, partner_of).collect()}
    assert len(found) == 4095
    for subset in rng.sample(sorted(found), 300):
        covered = [row for row in info if partners[row[0]] & set(subset.split("+"))]
        assert found[subset] == (len(covered), sum(r[1] for r in covered), len(covered), 0)
    lift = {r["subset"]: r for r in licensing.partner_lift(*frames, partner_of, "P03").collect()}
    assert lift["P03"]["opens_change"] == 0 and lift["P03+P04"]["opens_change"] == found["P03+P04"][1] - found["P03"][1]
    with pytest.raises(ValueError, match="choices"):
        licensing.partner_coverage(*frames, {f"c{i}": f"P{i}" for i in range(21)})


def test_sketched_overlap_of_many_identifiers(spark):
    n = 60_000
    info = spark.range(n).selectExpr("cast(id as string) identifier", "1 opens", "1 clicks", "1 conversions")
    owned = spark.range(2 * n).selectExpr("cast(id as string) identifier", "case when id % 3 = 0 then 'AudienceAcuityPair' when id % 7 = 0 then 'TowerData' else 'other' end license")
    exact = {r["subset"]: r["identifiers"] for r in licensing.partner_coverage(info, owned).collect()}
    found = {r["subset"]: r["identifiers"] for r in licensing.partner_overlap_approx(info, owned).collect()}
    assert set(found) == set(exact) and found["LiveRamp"] == exact["LiveRamp"] == 0
    # four standard errors of all identifiers of either side
    assert all(abs(found[s] - exact[s]) <= 4 * 2 * n / 2**7 for s in exact)
    assert any(found[s] != exact[s] for s in exact)
    nothing = licensing.partner_overlap_approx(info.limit(0), owned.limit(0)).collect()
    assert {r["identifiers"] for r in nothing} == {0}
