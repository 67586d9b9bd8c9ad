"""Column functions on maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_merge(left: Column, right: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Key-wise merge: ``merge(left, right)`` for a key of both maps, else the one value there is.

    A null map counts as empty. A key with a null value counts as present.
    """

    def pick(key: Column, a: Column, b: Column) -> Column:
        in_left, in_right = F.map_contains_key(left, key), F.map_contains_key(right, key)
        return F.when(in_left & in_right, merge(a, b)).when(in_left, a).otherwise(b)

    # map_zip_with is null as soon as one map is null
    return F.coalesce(F.map_zip_with(left, right, pick), left, right, F.create_map())


def map_union_strict(left: Column, right: Column) -> Column:
    """Union of two maps without a common key; a common key is an error."""
    common = F.array_intersect(F.map_keys(left), F.map_keys(right))
    return F.when(
        F.size(common) > 0,
        F.raise_error(F.concat(F.lit("key in both maps: "), F.element_at(common, 1).cast("string"))),
    ).otherwise(F.map_concat(left, right))
