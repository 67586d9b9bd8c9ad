"""Exact quantiles of groups of any size: sketches bracket them, and only values inside the brackets are put in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.session import materialize

SKETCH = 2048  # size of a sketch; its ranks are off by about 0.2 % of a group's values
MARGIN = 0.006  # share of a group's values on either side of a quantile that its bracket takes in


def _brackets(rows: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Rows (g, i, rank, sketch): the place of each quantile in its group and the group's sketch; written."""
    value = F.col("v").cast("double")
    sketches = rows.groupBy("g").agg(F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("sketch"), F.count("*").alias("total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("share")) for i, p in enumerate(shares)])
    each = sketches.select("g", "total", "sketch", F.inline(wanted))
    return materialize(each.withColumn("rank", F.greatest(F.ceil(F.col("total") * F.col("share")), F.lit(1))), "sketches")


def _counted(rows: DataFrame, brackets: DataFrame, shares: Sequence[float], margin: float) -> DataFrame:
    """Rows (g, i, rank, v, n): counts of the values inside each bracket, and with a null ``v`` of those below; written.

    From a margin of 1 on every value is inside.
    """
    if margin < 1:
        ranks = [[max(p - margin, 0.0) for p in shares], [min(p + margin, 1.0) for p in shares]]
        # a sketch of nothing but NaN is empty and has no quantiles
        some = F.kll_sketch_get_n_double("sketch") > 0
        ends = [F.when(some, F.get(F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, r))), F.col("i"))) for r in ranks]
    else:
        ends = [F.lit(None).cast("double")] * 2
    bounds = brackets.select("g", "i", "rank", ends[0].alias("low"), ends[1].alias("high"))
    # one row for each group
    bounds = materialize(bounds.groupBy("g").agg(F.collect_list(F.struct("i", "rank", "low", "high")).alias("b")).withColumnRenamed("g", "_g"), "brackets")
    met = rows.join(bounds, F.col("g").eqNullSafe(F.col("_g"))).select("g", "v", F.inline("b"))
    value = F.col("v").cast("double")
    below = F.coalesce(value < F.col("low"), F.lit(False))
    inside = met.where(F.coalesce(value <= F.col("high"), F.lit(True)) | below).select("g", "i", "rank", F.when(~below, F.col("v")).alias("v"))
    return materialize(inside.groupBy("g", "i", "rank", "v").agg(F.count("*").alias("n")), "inside")


def _selected(counts: DataFrame) -> DataFrame:
    """Rows (g, i, q) from counts (g, i, rank, v, n): the least value that at least ``rank`` values do not exceed; null if it is not inside.

    The counts are put in order by a range partitioning, so the values of one group are spread over tasks, and only totals per
    (partition, group) are summed up.
    """
    key = ["g", "i"]
    dealt = counts.repartitionByRange("g", "i", F.asc_nulls_first("v")).select("*", F.spark_partition_id().alias("part"))
    dealt = materialize(dealt, "quantiles")
    sums = dealt.groupBy(*key, "part").agg(F.sum("n").alias("s"))
    # one row for each partition of a group
    before = F.sum("s").over(Window.partitionBy(*key).orderBy("part")) - F.col("s")
    parts = materialize(sums.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("part").alias("_part"), before.alias("before")), "quantiles")
    same = dealt["g"].eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")) & (F.col("part") == F.col("_part"))
    placed = dealt.join(parts, same)
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("g", "i", "part").orderBy(F.asc_nulls_first("v")))
    reached = placed.withColumn("upto", upto)
    first = F.col("upto") - F.col("n")
    found = reached.groupBy(*key).agg(F.max(F.when((F.col("upto") >= F.col("rank")) & (first < F.col("rank")), F.struct("v"))).alias("hit"))
    return found.select(*key, F.col("hit.v").alias("q"))


def exact_quantiles(df: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """Rows (group, q) with an array of the least values that at least each share of the group's values do not exceed.

    Null values are left out; null is a group of its own. A mergeable sketch of each group gives a bracket around each quantile; a second
    pass counts the values below and inside the brackets, of which only the latter, about a hundredth, are exchanged one by one. A bracket that the
    quantile turns out not to lie in is made four times as wide, until it takes in everything: the result is exact.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    left, margin, found = _brackets(rows, shares), MARGIN, []
    while True:
        known = materialize(_selected(_counted(rows, left, shares, margin)), "found")
        found.append(known.where(F.col("q").isNotNull()))
        missed = known.where(F.col("q").isNull()).select(F.col("g").alias("_g"), F.col("i").alias("_i"))
        if margin >= 1 or missed.isEmpty():
            break
        left = materialize(left.join(missed, F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")), "left_semi"), "sketches")
        margin *= 4
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    wanted = [F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))]
    return every.groupBy("g").agg(*wanted).select(F.col("g").alias(group), F.array(*[f"q{i}" for i in range(len(shares))]).alias("q"))
