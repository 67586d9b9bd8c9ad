"""Substring deduplication by sliding spans of several consecutive sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.repeats import full, later_copies, long_windows_of, without

SPAN = 2
MIN_WORDS = 12
# a sentence ends with its mark and one white space, or with a line
CUT = r"(?<=[.!?][ \t\r\n]|\n)(?=[^ \t\r\n])"
# a long sentence is cut on, at places that only its own last characters decide
LONG = 24
INNER = r"(?<=[,;:nt] )"
WORD = r"[^ \t\n\x0B\f\r]+"


def _sentences(text: Column) -> Column:
    whole = F.split(F.coalesce(text, F.lit("")), CUT, -1)
    parts = F.transform(whole, lambda s: F.when(F.regexp_count(s, F.lit(WORD)) > LONG, F.split(s, INNER, -1)).otherwise(F.array(s)))
    return F.flatten(parts)


def _key(sentence: Column) -> Column:
    return F.trim(F.translate(sentence, "\t\r\n\x0b\x0c", "     "))


def dedupe_spans(docs: DataFrame, text: str = "text", id_column: str = "doc_id", span: int = SPAN, min_words: int = MIN_WORDS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the sentences cut out that a later copy of a repeated span covers.

    A sentence ends after ``.``, ``!`` or ``?`` and one white space, or at a newline; sentences are compared without surrounding
    ASCII white space. Sentences of more than ``LONG`` words are cut on after a comma, semicolon, colon or a word that ends in n or t, so
    that a passage without marks is found inside another sentence too; the parts count as sentences. From every sentence there is a span: the shortest run of at least ``span`` sentences and ``min_words``
    words, so that runs of a few short sentences, which independent texts share by chance, are no copies. Of equal spans, over all documents, the first by
    (identifier, place) stays and the sentences of all others go. A sentence goes only if an earlier copy of it exists. What
    stays keeps its own white space. Documents too short for a span stay; texts without a cut sentence come back
    unchanged, null included. Rows with a null identifier stay and give no copies; rows sharing one are treated as one
    document. ``counts`` names two columns to add: sentences and sentences removed.
    """
    mark = "_covered"
    while mark in docs.columns:
        mark += "_"
    covered = later_copies(docs, id_column, long_windows_of(full(_sentences(F.col(text)), _key), span, min_words)).withColumnRenamed("covered", mark)
    joined = docs.join(covered, id_column, "left")
    cut = F.when(F.col(mark).isNull(), F.col(text)).otherwise(F.array_join(without(_sentences(F.col(text)), _key, F.col(mark)), ""))
    extra = [] if counts is None else [F.size(full(_sentences(F.col(text)), _key)).cast("long").alias(counts[0]), F.coalesce(F.size(mark), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *extra)
