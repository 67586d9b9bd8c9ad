"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into ``SEGMENTS`` segments that stand in a ring. If two fingerprints differ in at most d bits,
there is a segment from which every chain of the next l segments differs in at most l * d / SEGMENTS bits. With five segments
and two bits the budgets of a chain are 0, 0, 1, 1, 2: two consecutive segments are equal, and of the next two at least one
is. So each fingerprint is filed under ten keys of about 38 bits (five starts, one of two third segments); pairs that
meet under a key must keep the budgets of the whole chain, and only then is the full distance taken.

Fingerprints are compared once however many documents have them. The links of one fingerprint are at most the 2,080
others within two bits, so links stay linear in the fingerprints; those that share a key meet in a sort-merge join
of two written tables, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.llm import vec
from hashgrove.llm.components import components
from hashgrove.session import materialize

SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
DISTANCE = 2
BITS_AT_ONCE = 1 << 16


def _fingerprint(text: bytes, shingle: int) -> int:
    """Fingerprint of one text; whole documents of any length, ``BITS_AT_ONCE`` shingles at a time."""
    words = text.lower().split()
    if not words:
        return 0
    runs = [words[i:] for i in range(min(shingle, len(words)))]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.array([digest(join(run), SEED) for run in zip(*runs, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        ones += np.unpackbits(hashes[i : i + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Rows (id, fingerprint as a signed long) for every row.

    A-Z are lower-cased, words are separated by ASCII white space, shingles are ``shingle`` words (3: the contract of this
    operator), repeats included. Fewer words: the whole sequence; a null, empty or blank text: zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.buffers(batch.column(1))
            raw = memoryview(data)
            found = np.fromiter((_fingerprint(bytes(raw[a:b]), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fingerprint bigint")
    return out.withColumnRenamed("id", id_column)


def _masks() -> list[int]:
    """Signed bit masks of the ring's segments."""
    masks, low = [], 0
    for width in WIDTHS:
        mask = ((1 << width) - 1) << low
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
        low += width
    return masks


def _differing(a: Column, b: Column, mask: int = -1) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask)))


def close_pairs(distinct: DataFrame, column: str = "fingerprint", distance: int = DISTANCE) -> DataFrame:
    """Pairs (x < y) of different fingerprints within ``distance`` (at most 2) bits; ``distinct`` has each once, in a written table."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the ring of {len(WIDTHS)} segments is laid out for distances up to {DISTANCE}")
    masks, n = _masks(), len(WIDTHS)
    keys = []
    for start in range(n):
        for third in (2, 3):
            mask = masks[start] | masks[(start + 1) % n] | masks[(start + third) % n]
            keys.append(F.struct(F.lit(start * n + third).alias("ring"), F.col(column).bitwiseAND(F.lit(mask)).alias("part")))

    def filed(name: str) -> DataFrame:
        return distinct.select(F.col(column).alias(name), F.explode(F.array(*keys)).alias("k")).select(name, "k.ring", "k.part")

    x, y = F.col("x"), F.col("y")
    chain = F.lit(False)
    for start in range(n):
        # the first two segments are equal under the key; budgets of the third, fourth and fifth follow
        third = _differing(x, y, masks[(start + 2) % n])
        fourth = third + _differing(x, y, masks[(start + 3) % n])
        chain = chain | ((F.floor(F.col("ring") / n) == start) & (third <= 3 * distance // n) & (fourth <= 4 * distance // n))
    met = filed("x").join(filed("y"), ["ring", "part"]).where((x < y) & chain & (_differing(x, y) <= distance))
    return met.select("x", "y").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """Rows (id, fingerprint, component) for every row: the component is the smallest identifier reachable by links.

    Documents with one fingerprint are linked whatever their texts; so are repeated rows. A row with a null identifier
    keeps its fingerprint, joins the component of its fingerprint if that has an identifier, and has a null component
    otherwise. An empty table gives an empty result; other columns are not looked at.
    """
    signed = materialize(fingerprints(docs, text, id_column, shingle), "simhash")
    distinct = materialize(signed.groupBy("fingerprint").agg(F.min(id_column).alias("least")), "simhash")
    pairs = materialize(close_pairs(distinct.where(F.col("least").isNotNull()).select("fingerprint"), distance=distance), "simhash")
    members = components(pairs, "x", "y")
    # components are of fingerprints; each gets the least identifier of its members
    grouped = materialize(members.join(distinct, members["node"] == distinct["fingerprint"]).select("node", "component", "least"), "simhash")
    named = grouped.groupBy("component").agg(F.min("least").alias("named"))
    moved = grouped.join(named, "component").select(F.col("node").alias("fingerprint"), "named")
    lookup = materialize(distinct.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("named", "least").alias("component")), "simhash")
    return signed.join(lookup, "fingerprint").select(id_column, "fingerprint", "component")


def keep_first(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **how: int) -> DataFrame:
    """``docs`` without those whose component has a smaller identifier.

    Rows with a null identifier cannot be named in a component and stay. Of repeated rows with one identifier the one with the
    least text (nulls first) stays, whatever else they hold.
    """
    groups = near_duplicates(docs, text, id_column, **how)
    dropped = groups.where(F.col("component") < F.col(id_column)).select(id_column).distinct()
    kept = docs.join(dropped, id_column, "left_anti")
    named, nameless = kept.where(F.col(id_column).isNotNull()), kept.where(F.col(id_column).isNull())
    place = Window.partitionBy(id_column).orderBy(text)
    mark = "_place"
    while mark in docs.columns:
        mark += "_"
    return named.withColumn(mark, F.row_number().over(place)).where(F.col(mark) == 1).drop(mark).union(nameless).select(docs.columns)
