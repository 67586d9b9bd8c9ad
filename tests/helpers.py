"""Small helpers shared by the tests."""

from __future__ import annotations

import math

import pandas as pd


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def _value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not hasattr(v, "__float__"):
        return str(v)
    return float(v)


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows of a pandas frame, columns by name, rows sorted, values comparable between engines."""
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=repr)
