"""Licence coverage of identifiers by partner, overlap of partners and change of partner."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hashgrove.session import materialize

# Licence code -> partner; the partner in use.
PARTNER_OF = {
    "AudienceAcuityMain": "Audience Accuity",
    "AudienceAcuityPair": "Audience Accuity",
    "LiveRampPelFile": "LiveRamp",
    "TowerData": "TowerData",
}
CURRENT_PARTNER = "LiveRamp"

TOTALS = ("opens", "clicks", "conversions")


def _partners(partner_of: Mapping[str, str]) -> list[str]:
    return sorted(set(partner_of.values()))


def partner_name(code: Column, partner_of: Mapping[str, str] = PARTNER_OF) -> Column:
    """Partner of a licence code, null for an unmapped one."""
    name = F.lit(None).cast("string")
    for c, partner in partner_of.items():
        name = F.when(code == c, partner).otherwise(name)
    return name


def unmapped_codes(licenses: DataFrame, partner_of: Mapping[str, str] = PARTNER_OF) -> DataFrame:
    """Licence codes no partner is known for, with their number of rows."""
    unknown = partner_name(F.col("license"), partner_of).isNull()
    return licenses.where(unknown).groupBy("license").agg(F.count(F.lit(1)).alias("n"))


def identifier_masks(
    info: DataFrame, licenses: DataFrame, partner_of: Mapping[str, str] = PARTNER_OF
) -> DataFrame:
    """Each known identifier's totals, its partner set as bits, and whether it has any licence row.

    One aggregate over both tables stands in for the join: each side is combined before the shuffle,
    so a repeated identifier costs one row per map task.
    """
    bit = F.lit(0)
    for i, partner in enumerate(_partners(partner_of)):
        codes = [c for c, p in partner_of.items() if p == partner]
        bit = F.when(F.col("license").isin(codes), 1 << i).otherwise(bit)
    zero = F.lit(0).cast("bigint")
    sides = info.select(
        "identifier",
        *[F.col(t).cast("bigint").alias(t) for t in TOTALS],
        F.lit(0).alias("mask"),
        F.lit(True).alias("known"),
        F.lit(False).alias("licensed"),
    ).unionByName(
        licenses.select(
            "identifier",
            *[zero.alias(t) for t in TOTALS],
            bit.alias("mask"),
            F.lit(False).alias("known"),
            F.lit(True).alias("licensed"),
        )
    )
    return (
        sides.where("identifier is not null")
        .groupBy("identifier")
        .agg(
            *[F.sum(t).alias(t) for t in TOTALS],
            F.bit_or("mask").alias("mask"),
            F.bool_or("known").alias("known"),
            F.bool_or("licensed").alias("licensed"),
        )
        .where("known")
        .drop("known")
    )


def unlicensed(info: DataFrame, licenses: DataFrame) -> DataFrame:
    """Identifiers without any licence."""
    return identifier_masks(info, licenses).where("not licensed").select("identifier")


def _by_mask(info: DataFrame, licenses: DataFrame, partner_of: Mapping[str, str]) -> DataFrame:
    masks = identifier_masks(info, licenses, partner_of)
    return masks.groupBy("mask").agg(
        F.count(F.lit(1)).alias("identifiers"), *[F.sum(t).alias(t) for t in TOTALS]
    )


def _mask_name(mask: Column, partners: list[str]) -> Column:
    return F.concat_ws(
        "+", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, p) for i, p in enumerate(partners)]
    )


def partner_overlap(
    info: DataFrame, licenses: DataFrame, partner_of: Mapping[str, str] = PARTNER_OF
) -> DataFrame:
    """Totals per exact set of partners; the empty set holds identifiers no partner covers."""
    cells = _by_mask(info, licenses, partner_of)
    return cells.withColumn("partners", _mask_name(F.col("mask"), _partners(partner_of)))


# All choices of more partners than this are too many to list.
MOST_PARTNERS = 20


def subset_sums(cells: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Rows (mask, columns) for each of the 2^n sets: sums over the ``cells`` (mask, columns) of all sets within it; written.

    One pass for each member adds the sums of the sets without it to those with it, so the work is n times the sets, not all pairs of them.
    """
    none = cells.sparkSession.range(1 << n).select(F.col("id").alias("mask"), *[F.lit(0).cast("bigint").alias(c) for c in columns])
    sums = none.unionByName(cells.select(F.col("mask").cast("bigint").alias("mask"), *columns)).groupBy("mask").agg(*[F.sum(c).alias(c) for c in columns])
    for i in range(n):
        bit = F.lit(1 << i).cast("bigint")
        without = F.col("mask").bitwiseAND(bit) == 0
        both = F.when(without, F.array("mask", F.col("mask").bitwiseOR(bit))).otherwise(F.array("mask"))
        sums = sums.select(F.explode(both).alias("mask"), *columns).groupBy("mask").agg(*[F.sum(c).alias(c) for c in columns])
    return materialize(sums, "subsets")


def _covered(info: DataFrame, licenses: DataFrame, partner_of: Mapping[str, str]) -> tuple[DataFrame, Row]:
    """Rows (mask, totals) of each choice of one or more partners, an identifier counted once, and the totals of all identifiers.

    What a choice covers is what the sets without any of its partners leave.
    """
    n = len(_partners(partner_of))
    if n > MOST_PARTNERS:
        raise ValueError(f"{n} partners have more than 2^{MOST_PARTNERS} choices")
    columns = ("identifiers", *TOTALS)
    sums = subset_sums(_by_mask(info, licenses, partner_of), n, columns)
    whole = (1 << n) - 1
    total = sums.where(F.col("mask") == whole).first()
    left = sums.where(F.col("mask") != whole)
    return left.select((F.lit(whole) - F.col("mask")).alias("mask"), *[(F.lit(total[c]) - F.col(c)).alias(c) for c in columns]), total


def partner_coverage(
    info: DataFrame, licenses: DataFrame, partner_of: Mapping[str, str] = PARTNER_OF
) -> DataFrame:
    """Totals available with each choice of one or more partners, an identifier counted once."""
    cells, _ = _covered(info, licenses, partner_of)
    return cells.select(_mask_name(F.col("mask"), _partners(partner_of)).alias("subset"), "identifiers", *TOTALS)


def partner_overlap_approx(info: DataFrame, licenses: DataFrame, partner_of: Mapping[str, str] = PARTNER_OF, log_size: int = 14) -> DataFrame:
    """Rows (subset, identifiers): estimates of the known identifiers that each choice of partners covers, without bringing identifiers together.

    Each partner and the known identifiers have a Theta sketch of 2^``log_size`` entries, a few of them on the driver. The standard error
    is about 1 / sqrt(2^``log_size``) (0.8 % by default) of the identifiers that either side has.
    """
    partners = _partners(partner_of)
    if len(partners) > MOST_PARTNERS:
        raise ValueError(f"{len(partners)} partners have more than 2^{MOST_PARTNERS} choices")
    known = info.agg(F.theta_sketch_agg("identifier", F.lit(log_size))).first()[0]
    owned = licenses.select("identifier", partner_name(F.col("license"), partner_of).alias("partner")).where("partner is not null")
    sketches = {r["partner"]: r["s"] for r in owned.groupBy("partner").agg(F.theta_sketch_agg("identifier", F.lit(log_size)).alias("s")).collect()}
    spark, mask = info.sparkSession, F.col("id")
    empty = spark.range(0).agg(F.theta_sketch_agg("id", F.lit(log_size))).first()[0]
    united = F.lit(empty)
    for i, partner in enumerate(partners):
        if partner in sketches:
            own = F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(sketches[partner])).otherwise(F.lit(empty))
            united = F.theta_union(united, own, F.lit(log_size))
    found = F.theta_sketch_estimate(F.theta_intersection(F.lit(known), united))
    return spark.range(1, 1 << len(partners)).select(_mask_name(mask, partners).alias("subset"), found.alias("identifiers"))


def partner_totals(
    info: DataFrame, licenses: DataFrame, partner_of: Mapping[str, str] = PARTNER_OF
) -> DataFrame:
    """Totals per partner, an identifier counted once per partner."""
    coverage = partner_coverage(info, licenses, partner_of)
    return coverage.where(F.col("subset").isin(_partners(partner_of))).select(
        F.col("subset").alias("partner"), "identifiers", *TOTALS
    )


def partner_lift(
    info: DataFrame,
    licenses: DataFrame,
    partner_of: Mapping[str, str] = PARTNER_OF,
    current: str = CURRENT_PARTNER,
) -> DataFrame:
    """Each choice of partners against the current partner alone, and its share of all totals."""
    partners = _partners(partner_of)
    cells, total = _covered(info, licenses, partner_of)
    now = cells.where(F.col("mask") == (1 << partners.index(current))).first()
    columns = ("identifiers", *TOTALS)
    return cells.select(
        _mask_name(F.col("mask"), partners).alias("subset"),
        *[(F.col(c) - F.lit(now[c])).alias(f"{c}_change") for c in columns],
        *[(F.col(c) / F.lit(total[c]) if total[c] else F.lit(None).cast("double")).alias(f"{c}_share") for c in columns],
    )
