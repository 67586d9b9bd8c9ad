"""Joins of rows with a table of one row per key, and dealing rows over places.

The keyed table is written first. A join of two written tables is a plain shuffle stage on either side, so adaptive
execution broadcasts a side that turns out small and splits a key that turns out hot; next to an aggregate it could not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashgrove.session import materialize


def place_of(df: DataFrame, places: int) -> Column:
    """A place for each row by a hash of the whole row, so that rows of one key are dealt over all places.

    A retried task works out the same places again. Columns that hold maps, which have no hash, are left out.
    """

    def hashable(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return hashable(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(hashable(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f.dataType)]
    return F.pmod(F.xxhash64(*columns), F.lit(places))


def clustered(df: DataFrame, by: str, places: int) -> DataFrame:
    """``df`` with the rows of a value of ``by`` dealt over at most ``places`` tasks, so that a partitioned write opens few files."""
    mark = "_place"
    while mark in df.columns:
        mark += "_"
    return df.withColumn(mark, place_of(df, places)).repartition(by, mark).drop(mark)


def left_join(df: DataFrame, table: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Add to each row the values of its key in ``table``, which has one row per key; null values where there is none.

    A null in a key equals nothing, or with ``null_safe`` another null. A hot key is split by the tasks that hold its rows: what
    was brought into one task by a partitioning of the caller's own stays in one.
    """
    matched = [f"_m_{k}" for k in keys]
    values = [c for c in table.columns if c not in keys]
    written = materialize(table.select(*[F.col(k).alias(m) for k, m in zip(keys, matched)], *values), "keyed")
    pairs = [(F.col(k), F.col(m)) for k, m in zip(keys, matched)]
    same = reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])
    return df.join(written, same, "left").select(*df.columns, *values)
