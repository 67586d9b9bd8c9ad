"""Text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.operators.keyed import clustered


def text_lines(df: DataFrame, separator: str | None = None) -> Column:
    """One line per record: JSON, or the fields joined by ``separator`` (null as empty)."""
    if separator is None:
        return F.to_json(F.struct(*df.columns)).alias("value")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return F.concat_ws(separator, *fields).alias("value")


def write_text(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    compression: str | None = None,
    separator: str | None = None,
    single_file: bool = False,
    mode: str = "errorifexists",
    files_per_value: int = 64,
) -> None:
    """Write one line per record, below one folder per ``partition_by`` value if given, in at most ``files_per_value`` files each.

    ``single_file`` is for small results only; the work before it stays parallel.
    """
    fields = df.drop(partition_by) if partition_by else df
    lines = df.select(*([partition_by] if partition_by else []), text_lines(fields, separator))
    if single_file:
        lines = lines.repartition(1)
    elif partition_by:
        lines = clustered(lines, partition_by, files_per_value)
    writer = lines.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)
