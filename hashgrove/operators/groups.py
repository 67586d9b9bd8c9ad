"""Subtotals over (bidder, group): moments, sums, category frequencies, comparison and report.

A row with a bidder and a hash belongs to up to six groups. Copying rows to their groups before
aggregating would multiply the data and make the ``ALL`` groups hot. So rows are first aggregated to
cells, one per (bidder, hash or not), and only the cells are copied and merged.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.functions.text import filled
from hashgrove.operators import impressions as imp
from hashgrove.operators import sketches
from hashgrove.session import materialize

# Names of groups, reserved bidders and report labels; number of heavy hitters.
ALL, ALL_RTB = "ALL", "ALL-RTB"
NO_HASH, OUTSIDE_GROUPS, UNKNOWN_BIDDER = "NO-HASH", "OUTSIDE-GROUPS", "UNKNOWN-BIDDER"
NO_LABEL, NO_DESCRIPTION = "NO-LABEL", "NO-DESCRIPTION"
TOP_VALUES = 50

GROUP = ("bidder", "grp")
CELL = ("bidder_key", "has_hash")


@dataclass(frozen=True)
class Category:
    """A category column: the raw value to count and how to name it.

    Names are worked out on the counted raw values, not on each row.
    """

    source: Column
    label: Callable[[Column], Column] = lambda value: value


@dataclass(frozen=True)
class GroupStatistics:
    """Long tables per group.

    moments: measure, n, mean, m2 (sum of squared deviations); sums: measure, total;
    categories: measure, value, n; rests: like moments, over the bidder's rows outside the group, where
    they are known.
    """

    moments: DataFrame
    sums: DataFrame
    categories: DataFrame
    rests: DataFrame | None = None


def _group_array(
    bidder: Column, has_hash: Column, no_all: bool, no_all_rtb: bool, dedupe_keys: bool
) -> Column:
    def pairs(*named: tuple[Column, str]) -> Column:
        both = [(b, F.lit(g)) for b, name in named for g in (name, ALL)]
        made = F.array(*[F.struct(b.alias("bidder"), g.alias("grp")) for b, g in both])
        return F.array_distinct(made) if dedupe_keys else made

    everyone, rtb = F.lit(ALL), F.lit(ALL_RTB)
    groups = (
        F.when(bidder.isNull() & ~has_hash, pairs((everyone, NO_HASH)))
        .when(bidder.isNull(), pairs((everyone, OUTSIDE_GROUPS)))
        .when(
            ~has_hash,
            pairs(
                (everyone, NO_HASH), (rtb, NO_HASH), (bidder, NO_HASH), (bidder, UNKNOWN_BIDDER)
            ),
        )
        .otherwise(
            pairs((everyone, OUTSIDE_GROUPS), (rtb, OUTSIDE_GROUPS), (bidder, UNKNOWN_BIDDER))
        )
    )
    reserved = [name for name, off in ((ALL, no_all), (ALL_RTB, no_all_rtb)) if off]
    return F.filter(groups, lambda g: ~g["bidder"].isin(reserved)) if reserved else groups


def fan_out_groups(
    df: DataFrame,
    bidder: Column,
    id_hash: Column,
    no_all: bool = False,
    no_all_rtb: bool = False,
    dedupe_keys: bool = True,
) -> DataFrame:
    """Copy each row to each of its groups, named by ``bidder`` and ``grp``.

    ``dedupe_keys=False`` keeps a group that arises twice for a row twice.
    """
    groups = _group_array(
        bidder.cast("string"), id_hash.isNotNull(), no_all, no_all_rtb, dedupe_keys
    )
    return df.select("*", F.inline(groups))


def _aggregate_cells(
    df: DataFrame,
    keys: dict[str, Column],
    moments: Mapping[str, Column],
    sums: Mapping[str, Column],
    sources: Mapping[str, Column],
) -> DataFrame:
    """One pass: statistics rows (``source`` null) and raw category counts per key."""
    names = [*moments, *sums]
    values = {**moments, **sums}
    rows = df.select(
        *[c.alias(k) for k, c in keys.items()],
        *[values[m].alias(f"_v_{i}") for i, m in enumerate(names)],
        F.explode(
            F.array(
                F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("value")),
                *[
                    F.struct(F.lit(s).alias("source"), c.cast("string").alias("value"))
                    for s, c in sources.items()
                ],
            )
        ).alias("_c"),
    ).select("*", "_c.*")
    own = F.col("source").isNull()
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        value = F.when(own, F.col(f"_v_{i}"))
        if name in moments:
            # the average of equal values is that value, whatever rounding says
            same = F.when(F.min(value) == F.max(value), F.min(value).cast("double"))
            aggregates += [
                F.count(value).alias(f"n_{i}"),
                F.coalesce(same, F.avg(value)).alias(f"mean_{i}"),
                (F.var_pop(value) * F.count(value)).alias(f"m2_{i}"),
            ]
        else:
            aggregates.append(F.sum(value.cast("bigint")).alias(f"total_{i}"))
    return rows.groupBy(*keys, "source", "value").agg(*aggregates)


def _split_cells(
    cells: DataFrame,
    keys: tuple[str, ...],
    moments: Mapping[str, Column],
    sums: Mapping[str, Column],
    categories: Mapping[str, Category],
    source_of: Mapping[str, str],
) -> GroupStatistics:
    names = [*moments, *sums]
    own = cells.where("source is null")
    moment_rows = [
        F.struct(
            F.lit(m).alias("measure"),
            *[F.col(f"{part}_{names.index(m)}").alias(part) for part in ("n", "mean", "m2")],
        )
        for m in moments
    ]
    sum_rows = [
        F.struct(F.lit(m).alias("measure"), F.col(f"total_{names.index(m)}").alias("total"))
        for m in sums
    ]
    moment_type = "array<struct<measure:string,n:bigint,mean:double,m2:double>>"
    sum_type = "array<struct<measure:string,total:bigint>>"
    counted = cells.where("source is not null and value is not null")
    named = F.array(
        *[
            F.when(
                F.col("source") == source_of[m],
                F.struct(F.lit(m).alias("measure"), c.label(F.col("value")).alias("value")),
            )
            for m, c in categories.items()
        ]
    ).cast("array<struct<measure:string,value:string>>")
    category_rows = counted.select(*keys, F.inline(F.array_compact(named)), "n")
    return GroupStatistics(
        own.select(*keys, F.inline(F.array(*moment_rows).cast(moment_type))).where("n > 0"),
        own.select(*keys, F.inline(F.array(*sum_rows).cast(sum_type))).where("total is not null"),
        category_rows.where("value is not null"),
    )


def _sources(categories: Mapping[str, Category]) -> tuple[dict[str, Column], dict[str, str]]:
    """Raw columns to count, each once though several categories may read it."""
    sources: dict[str, Column] = {}
    source_of: dict[str, str] = {}
    known: dict[str, str] = {}
    for name, category in categories.items():
        # columns of equal text are the same expression
        key = known.setdefault(str(category.source), f"s{len(known)}")
        sources[key] = category.source
        source_of[name] = key
    return sources, source_of


def _as_categories(categories: Mapping[str, Column | Category]) -> dict[str, Category]:
    return {k: v if isinstance(v, Category) else Category(v) for k, v in categories.items()}


def _merge_moments(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pool (n, mean, m2) per key around the pooled mean, found first."""
    # equal means stay what they are, so that values without spread get none by rounding
    least, greatest = F.min("mean"), F.max("mean")
    weighed = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    pooled = cells.groupBy(*keys, "measure").agg(
        F.sum("n").alias("n"), F.when(least == greatest, least).otherwise(weighed).alias("mean")
    )
    centre = pooled.select(*keys, "measure", F.col("n").alias("_n"), F.col("mean").alias("_mean"))
    gap = F.col("mean") - F.col("_mean")
    return (
        cells.join(centre, [*keys, "measure"])
        .groupBy(*keys, "measure")
        .agg(
            F.first("_n").alias("n"),
            F.first("_mean").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"),
        )
    )


def _rests(copies: DataFrame) -> DataFrame:
    """Moments of each group's rest from copies of cells: the cells of the bidder that are not in the group, pooled.

    Cells, not values, are compared and pooled, and nothing is subtracted.
    """
    cell = [F.col(c).alias(f"_{c}") for c in CELL]
    whole = copies.where(F.col("grp") == ALL).select("bidder", *cell, "measure", "n", "mean", "m2")
    # a bidder has at most four groups by construction
    names = copies.where(F.col("grp") != ALL).select("bidder", "grp").distinct()
    own = copies.where(F.col("grp") != ALL).select(F.col("bidder").alias("_b"), F.col("grp").alias("_g"), *[F.col(c).alias(f"_o_{c}") for c in CELL]).distinct()
    same = (F.col("bidder") == F.col("_b")) & (F.col("grp") == F.col("_g"))
    for c in CELL:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(f"_o_{c}"))
    return _merge_moments(whole.join(names, "bidder").join(own, same, "left_anti"), GROUP)


def _top_values(counts: DataFrame, keys: tuple[str, ...], top: int) -> DataFrame:
    """The ``top`` most frequent values per key and measure, ties by value."""
    rank = F.row_number().over(
        Window.partitionBy(*keys, "measure").orderBy(F.desc("n"), F.asc("value"))
    )
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")


def _merge_statistics(parts: GroupStatistics, keys: tuple[str, ...], top: int) -> GroupStatistics:
    counts = parts.categories.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    return GroupStatistics(
        _merge_moments(parts.moments, keys),
        parts.sums.groupBy(*keys, "measure").agg(F.sum("total").alias("total")),
        _top_values(counts, keys, top),
    )


def _sketched(
    df: DataFrame,
    keys: dict[str, Column],
    categories: Mapping[str, Category],
    fan_out: Callable[[DataFrame], DataFrame],
    top: int,
) -> DataFrame:
    """Heavy hitters by count-min sketches, one per key and category, merged where keys belong to several groups."""
    found = sketches.summarise(df, keys, {m: c.label(c.source) for m, c in categories.items()})
    grouped = sketches.regrouped(found, fan_out, GROUP)
    written = sketches.Sketch(GROUP, grouped.shape, materialize(grouped.cells, "sketch"), grouped.candidates)
    return sketches.heavy_hitters(written, top).withColumnRenamed("category", "measure").select(*GROUP, "measure", "value", "n")


def group_aggregates(
    df: DataFrame,
    moments: Mapping[str, Column] = {},
    sums: Mapping[str, Column] = {},
    categories: Mapping[str, Column | Category] = {},
    top: int = TOP_VALUES,
    approx: bool = False,
) -> GroupStatistics:
    """Statistics of rows that carry ``bidder`` and ``grp``; rows of an empty group are dropped.

    Null values are absent: a measure without any value in a group has no row there.
    """
    categories = _as_categories(categories)
    rows = drop_empty_group(df)
    keys = {k: F.col(k) for k in GROUP}
    sources, source_of = _sources({} if approx else categories)
    cells = _aggregate_cells(rows, keys, moments, sums, sources)
    parts = _split_cells(cells, GROUP, moments, sums, {} if approx else categories, source_of)
    stats = _merge_statistics(parts, GROUP, top)
    if approx:
        hitters = _sketched(rows, keys, categories, lambda d: d, top)
        stats = GroupStatistics(stats.moments, stats.sums, hitters)
    return stats


def drop_empty_group(df: DataFrame, grp: str = "grp") -> DataFrame:
    """Rows of a group with a name."""
    return df.where(F.col(grp) != "")


def bidder_statistics(
    df: DataFrame,
    bidder: Column,
    id_hash: Column,
    moments: Mapping[str, Column] = {},
    sums: Mapping[str, Column] = {},
    categories: Mapping[str, Column | Category] = {},
    top: int = TOP_VALUES,
    approx: bool = False,
    no_all: bool = False,
    no_all_rtb: bool = False,
    dedupe_keys: bool = True,
    written: bool = True,
) -> GroupStatistics:
    """``group_aggregates`` over ``fan_out_groups``, aggregating rows before they are copied.

    The cells are written first, so that all tables share one pass over ``df``; ``written=False``
    keeps the plan lazy at the price of a pass for each use. With ``approx`` the columns that count are written first, as they are
    read for the cells and for the sketches.
    """
    categories = _as_categories(categories)
    keys = {CELL[0]: bidder.cast("string"), CELL[1]: id_hash.isNotNull()}
    if approx and written:
        named = [*keys.items(), *[(f"_m_{i}", c) for i, c in enumerate(moments.values())], *[(f"_t_{i}", c) for i, c in enumerate(sums.values())]]
        named += [(f"_c_{i}", c.label(c.source)) for i, c in enumerate(categories.values())]
        df = materialize(df.select(*[c.alias(name) for name, c in named]), "group-columns")
        keys = {k: F.col(k) for k in keys}
        moments, sums = {m: F.col(f"_m_{i}") for i, m in enumerate(moments)}, {m: F.col(f"_t_{i}") for i, m in enumerate(sums)}
        categories = {m: Category(F.col(f"_c_{i}")) for i, m in enumerate(categories)}

    def fan_out(cells: DataFrame) -> DataFrame:
        groups = _group_array(
            F.col(CELL[0]), F.col(CELL[1]), no_all, no_all_rtb, dedupe_keys
        )
        return cells.select("*", F.inline(groups)).drop(*CELL)

    sources, source_of = _sources({} if approx else categories)
    cells = _aggregate_cells(df, keys, moments, sums, sources)
    if written:
        cells = materialize(cells, "group-cells")
    parts = _split_cells(cells, CELL, moments, sums, {} if approx else categories, source_of)
    stats = _merge_statistics(
        GroupStatistics(fan_out(parts.moments), fan_out(parts.sums), fan_out(parts.categories)),
        GROUP,
        top,
    )
    if approx:
        stats = GroupStatistics(stats.moments, stats.sums, _sketched(df, keys, categories, fan_out, top))
    copies = parts.moments.select("*", F.inline(_group_array(F.col(CELL[0]), F.col(CELL[1]), no_all, no_all_rtb, True)))
    return GroupStatistics(stats.moments, stats.sums, stats.categories, _rests(copies))


def union_disjoint(left: GroupStatistics, right: GroupStatistics) -> GroupStatistics:
    """Statistics of both sides; a measure that both have for one group is an error."""

    def united(a: DataFrame, b: DataFrame, repeats: tuple[str, ...]) -> DataFrame:
        sided = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
        both = sided.groupBy(*repeats).agg((F.min("_side") != F.max("_side")).alias("_both"))
        key = F.concat_ws("#", *repeats)
        checked = both.select(
            *repeats,
            F.when(F.col("_both"), F.raise_error(F.concat(F.lit("on both sides: "), key)))
            .otherwise(F.lit(True))
            .alias("_once"),
        )
        return sided.join(checked, list(repeats)).where("_once").drop("_side", "_once")

    repeats = (*GROUP, "measure")
    return GroupStatistics(
        united(left.moments, right.moments, repeats),
        united(left.sums, right.sums, repeats),
        united(left.categories, right.categories, repeats),
    )


def with_stddev(moments: DataFrame) -> DataFrame:
    """Add the population standard deviation, null where a value that is no number makes it none."""
    stddev = F.sqrt(F.col("m2") / F.col("n"))
    return moments.withColumn("stddev", F.when(~F.isnan(stddev), stddev))


def _counts(stats: GroupStatistics, name: str, as_name: str) -> DataFrame:
    """Count of a measure per group: its sum if there is one, else its number of values."""
    is_it = F.col("measure") == name
    summed = stats.sums.where(is_it).select(*GROUP, F.col("total").alias("_t"), F.lit(None).cast("bigint").alias("_n"))
    counted = stats.moments.where(is_it).select(*GROUP, F.lit(None).cast("bigint").alias("_t"), F.col("n").alias("_n"))
    return (
        summed.unionByName(counted)
        .groupBy(*GROUP)
        .agg(F.coalesce(F.max("_t"), F.max("_n")).alias(as_name))
    )


def mean_statistic(stats: GroupStatistics, name: str) -> DataFrame:
    """(mean, n, stddev) of one measure per group that has it."""
    return with_stddev(stats.moments.where(F.col("measure") == name)).select(
        *GROUP, "measure", "n", "mean", "stddev"
    )


def proportion_statistic(stats: GroupStatistics, name: str, total: str) -> DataFrame:
    """``hits`` of one measure (0 if absent) out of the ``total`` of another."""
    return (
        _counts(stats, total, "total")
        .join(_counts(stats, name, "hits"), list(GROUP), "left")
        .select(*GROUP, F.lit(name).alias("measure"), F.coalesce("hits", F.lit(0)).alias("hits"), "total")
    )


def category_statistic(stats: GroupStatistics, name: str, total: str) -> DataFrame:
    """Value frequencies of one category with the total of a measure, where both exist."""
    values = stats.categories.where(F.col("measure") == name)
    return values.join(_counts(stats, total, "total"), list(GROUP)).select(
        *GROUP, "measure", "value", "n", "total"
    )


def order_by_group(df: DataFrame) -> DataFrame:
    return df.orderBy(F.concat_ws("#", *GROUP))


def _z(diff: Column, var_a: Column, n_a: Column, var_b: Column, n_b: Column) -> Column:
    error = F.sqrt(var_a / n_a + var_b / n_b)
    return F.when(error > 0, diff / error)


def compare_groups(moments: DataFrame) -> DataFrame:
    """Difference of means and z score of every two groups of a bidder, in both directions.

    A bidder has at most four groups by construction, whatever the data.
    """
    a = moments.select(
        "bidder", "measure", F.col("grp").alias("grp_a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "mean", "m2")]
    )
    b = moments.select(
        "bidder", "measure", F.col("grp").alias("grp_b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "m2")]
    )
    diff = F.col("mean_a") - F.col("mean_b")
    return (
        a.join(b, ["bidder", "measure"])
        .where("grp_a <> grp_b")
        .select(
            "bidder",
            "grp_a",
            "grp_b",
            "measure",
            diff.alias("diff"),
            _z(
                diff,
                F.col("m2_a") / F.col("n_a"),
                F.col("n_a"),
                F.col("m2_b") / F.col("n_b"),
                F.col("n_b"),
            ).alias("z"),
        )
    )


def compare_with_rest(stats: GroupStatistics) -> DataFrame:
    """Each group of a bidder against that bidder's rows outside the group; a group of all of them has no row.

    The rest is pooled from the cells outside the group. Statistics of rows that are copied to their groups already do not know them.
    """
    if stats.rests is None:
        raise ValueError("the rows outside a group are known to bidder_statistics only")
    rest = stats.rests.select(*GROUP, "measure", *[F.col(c).alias(f"{c}_rest") for c in ("n", "mean", "m2")])
    diff = F.col("mean") - F.col("mean_rest")
    z = _z(diff, F.col("m2") / F.col("n"), F.col("n"), F.col("m2_rest") / F.col("n_rest"), F.col("n_rest"))
    return stats.moments.join(rest, [*GROUP, "measure"]).select(*GROUP, "measure", diff.alias("diff"), z.alias("z"))


# --- the impression report ---------------------------------------------------------------------

BIDDER = "bidder_id"


def impression_measures() -> dict[str, dict]:
    """Measures the report aggregates over impressions."""
    agent = F.col("user_agent")
    return {
        "moments": {
            "spend": F.coalesce("advertiser_spent", F.lit(0.0)),
            "clearingPrice": F.coalesce("clearing_price", F.lit(0.0)),
            "expProfit": imp.expected_profit(),
        },
        "sums": {"isRtb": F.when(F.col(BIDDER).isNotNull(), 1)},
        "categories": {
            "pricingTypes": Category(imp.pricing_category(F.col("pricing_type"))),
            "deviceTypes": Category(_present(agent), lambda a: imp.device_category(filled(a))),
            "oss": Category(_present(agent), lambda a: imp.os_category(filled(a))),
            "browsers": Category(_present(agent), lambda a: imp.browser_category(filled(a))),
            "sourcesImp": Category(imp.source_category(F.col("buyeruid_source"))),
        },
    }


def _present(value: Column) -> Column:
    """Missing text as empty, so that it is counted and named after counting."""
    return F.coalesce(value, F.lit(""))


def impression_statistics(impressions: DataFrame, **options) -> GroupStatistics:
    """Group statistics of deduplicated impressions."""
    return bidder_statistics(
        impressions, F.col(BIDDER), F.col("email_hash"), **impression_measures(), **options
    )


# Report column -> measure, or (measure, total), in the report's order. Measures the
# statistics lack give null, a lacking proportion measure 0 of its total.
MEANS = {
    "bids": "bidPrice",
    "nonZeroBids": "nonZeroBidPrice",
    "largeBids": "largeBidPrice",
    "spend": "spend",
    "clearingPrice": "clearingPrice",
    "expectedProfit": "expProfit",
}
PROPORTIONS = {
    "clicks": ("clicks", "spend"),
    "conversions": ("conversions", "spend"),
    "rtbWins": ("isRtb", "spend"),
    "responses": ("nonZeroBidPrice", "bidPrice"),
}
CATEGORIES = {
    "pricingTypes": ("pricingTypes", "spend"),
    "deviceTypes": ("deviceTypes", "spend"),
    "oss": ("oss", "spend"),
    "browsers": ("browsers", "spend"),
    "idaasIndices": ("idaasIndex", "bidPrice"),
}
# ``sources`` reads the first for the reserved bidder ALL, the second for all others.
SOURCES = (("sourcesImp", "spend"), ("sourcesBids", "bidPrice"))


def group_report(stats: GroupStatistics, day: str) -> DataFrame:
    """One row per group: definition and every statistic as a struct, null where it does not exist."""
    moment = F.struct("mean", "n", "stddev")
    moments = with_stddev(stats.moments).groupBy(*GROUP).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", moment.alias("m")))).alias("_m")
    )
    sums = stats.sums.groupBy(*GROUP).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "total"))).alias("_s")
    )
    # at most the heavy hitters of each category reach a list
    per_category = stats.categories.groupBy(*GROUP, "measure").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("_v")
    )
    categories = per_category.groupBy(*GROUP).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "_v"))).alias("_c")
    )
    # every group of sums or categories has rows, but a moment measure may be absent
    wide = moments.join(sums, list(GROUP), "full").join(categories, list(GROUP), "full")

    def count_of(name: str) -> Column:
        return F.coalesce(F.col("_s")[name], F.col("_m")[name]["n"])

    def proportion(name: str, total: str) -> Column:
        whole = count_of(total)
        made = F.struct(F.coalesce(count_of(name), F.lit(0)).alias("count"), whole.alias("total"))
        return F.when(whole.isNotNull(), made)

    def category(name: str, total: str) -> Column:
        values, whole = F.col("_c")[name], count_of(total)
        made = F.struct(values.alias("frequencies"), whole.alias("total"))
        return F.when(values.isNotNull() & whole.isNotNull(), made)

    return wide.select(
        F.lit(day).alias("date"),
        F.struct(
            *GROUP, F.lit(NO_LABEL).alias("label"), F.lit(NO_DESCRIPTION).alias("description")
        ).alias("definition"),
        *[F.col("_m")[m].alias(c) for c, m in MEANS.items()],
        *[proportion(*pair).alias(c) for c, pair in PROPORTIONS.items()],
        F.when(F.col("bidder") == ALL, category(*SOURCES[0]))
        .otherwise(category(*SOURCES[1]))
        .alias("sources"),
        *[category(*pair).alias(c) for c, pair in CATEGORIES.items()],
    )
