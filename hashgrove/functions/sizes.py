"""Memory-size estimate of a value, written as one native expression from its schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the estimate, in bytes.
WORD = 8  # scalar, header of a text or collection, pointer to an element or field
MAP_ENTRY = 16  # two pointers


def _is_scalar(dtype: T.DataType) -> bool:
    """Whether every value takes one word; raises for types without a rule."""
    if isinstance(dtype, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return False
    if not isinstance(dtype, (T.NumericType, T.BooleanType, T.DatetimeType, T.TimestampNTZType, T.AnyTimeType, T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        raise TypeError(f"no size rule for {dtype.simpleString()}")
    return True


def _total(items: Column, dtype: T.DataType) -> Column:
    """Sum of the estimates of an array's elements."""
    if _is_scalar(dtype):
        return F.size(items).cast("bigint") * WORD
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + size_estimate(x, dtype))


def size_estimate(value: Column, dtype: T.DataType) -> Column:
    """Estimated bytes of ``value``; a null counts as one word."""
    if _is_scalar(dtype):
        return F.lit(WORD).cast("bigint")
    if isinstance(dtype, T.StringType):
        # two bytes per UTF-16 unit; length() counts code points, the same in ASCII text only
        points = F.char_length(value)
        ascii_only = points == F.octet_length(value)
        units = F.when(ascii_only, points * 2).otherwise(F.octet_length(F.encode(value, "UTF-16BE")))
        size = units.cast("bigint") + WORD
    elif isinstance(dtype, T.BinaryType):
        size = F.octet_length(value).cast("bigint") + WORD
    elif isinstance(dtype, T.ArrayType):
        size = _total(value, dtype.elementType) + F.size(value) * WORD + WORD
    elif isinstance(dtype, T.MapType):
        size = (
            _total(F.map_keys(value), dtype.keyType)
            + _total(F.map_values(value), dtype.valueType)
            + F.size(value) * MAP_ENTRY
            + WORD
        )
    else:
        size = row_size(dtype, value)
    return F.coalesce(F.when(value.isNotNull(), size), F.lit(WORD).cast("bigint"))


def row_size(schema: T.StructType | DataFrame, record: Column | None = None) -> Column:
    """Estimated bytes of a record: one word per field plus the fields."""
    if isinstance(schema, DataFrame):
        schema = schema.schema
    total = F.lit(0).cast("bigint")
    for field in schema.fields:
        value = F.col(f"`{field.name}`") if record is None else record.getField(field.name)
        total = total + size_estimate(value, field.dataType) + WORD
    return total
