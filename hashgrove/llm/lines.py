"""Line deduplication by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.repeats import full, later_copies, windows_of, without

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))


def dedupe_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, counts: tuple[str, str] | None = None, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the later copies of repeated line windows cut out of ``text``.

    Lines are separated by a newline and compared without surrounding ASCII white space. Windows are ``window``
    consecutive lines, blank lines skipped, over all documents; of equal windows the first by (identifier, place) stays
    and the lines of all others go, overlapping ones merged. A line goes only if an earlier copy of it exists, so nothing
    is lost altogether. Documents of fewer lines have no window and stay; texts without a cut line come back unchanged, null
    included. Rows with a null identifier stay and give no copies; rows sharing one are treated as one document.
    ``counts`` names two columns to add: full lines and lines removed. With ``drop_emptied`` a document goes that had full lines
    and lost all of them, as whole copies do.
    """
    mark = "_covered"
    while mark in docs.columns:
        mark += "_"
    covered = later_copies(docs, id_column, windows_of(full(_lines(F.col(text)), _key), window)).withColumnRenamed("covered", mark)
    joined = docs.join(covered, id_column, "left")
    if drop_emptied:
        joined = joined.where(F.col(mark).isNull() | (F.size(mark) < F.size(full(_lines(F.col(text)), _key))))
    cut = F.when(F.col(mark).isNull(), F.col(text)).otherwise(F.array_join(without(_lines(F.col(text)), _key, F.col(mark)), "\n"))
    extra = [] if counts is None else [F.size(full(_lines(F.col(text)), _key)).cast("long").alias(counts[0]), F.coalesce(F.size(mark), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *extra)
