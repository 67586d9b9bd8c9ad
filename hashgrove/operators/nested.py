"""Operators on map columns and on the estimated size of rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.functions.sizes import row_size, size_estimate
from hashgrove.operators.keyed import left_join
from hashgrove.operators.quantiles import exact_quantiles
from hashgrove.session import materialize


def map_merge_agg(
    df: DataFrame,
    keys: Sequence[str],
    map_col: str,
    agg: Callable[[Column], Column],
    as_map: bool = False,
) -> DataFrame:
    """Merge the maps of many rows key by key with an aggregate such as ``F.sum``.

    Long form (keys, map_key, value) by default, which never gathers a group. ``as_map`` gathers
    each group's merged entries to one map.
    """
    entries = df.select(*keys, F.explode(map_col).alias("map_key", "value"))
    merged = entries.groupBy(*keys, "map_key").agg(agg(F.col("value")).alias("value"))
    if not as_map:
        return merged
    return merged.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("map_key", "value"))).alias(map_col)
    )


def with_size(df: DataFrame, name: str = "bytes") -> DataFrame:
    """Add the estimated size of each row."""
    return df.withColumn(name, row_size(df))


def size_by_column(df: DataFrame) -> DataFrame:
    """Total and greatest estimated size of each column, in one pass."""
    fields = df.schema.fields
    sizes = [size_estimate(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    one = df.agg(
        *[F.sum(s).alias(f"total_{i}") for i, s in enumerate(sizes)],
        *[F.max(s).alias(f"most_{i}") for i, s in enumerate(sizes)],
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.col(f"total_{i}").alias("bytes"),
            F.col(f"most_{i}").alias("most"),
        )
        for i, f in enumerate(fields)
    ]
    return one.select(F.inline(F.array(*rows)))


def size_outliers(
    df: DataFrame, id_col: str, group: str, top: int = 20, reach: float = 1.5
) -> DataFrame:
    """The ``top`` largest rows of each group above its upper quartile plus ``reach`` quartile ranges.

    Quartiles are exact, from counts per size. Only the ``top`` rows of a group and task are shuffled for the ranks.
    """
    # the rows may be large and their sizes are needed twice
    sizes = materialize(df.select(id_col, group, row_size(df).alias("bytes")), "sizes")
    quartiles = exact_quantiles(sizes, group, "bytes", [0.25, 0.75])
    low, high = F.col("q")[0], F.col("q")[1]
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("bytes"), id_col))
    return (
        left_join(sizes, quartiles, [group], null_safe=True)
        .withColumn("bound", high + F.lit(reach) * (high - low))
        .drop("q")
        .where(F.col("bytes") > F.col("bound"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= top)
    )
