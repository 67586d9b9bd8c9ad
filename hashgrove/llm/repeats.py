"""Repeated runs of consecutive units (lines, sentences): where the later copies stand.

Units are hashed in overlapping windows. Windows are counted over all documents, and every window but the first
(in order of document and place) marks the units it covers. Only hashes travel: a row of a window is 20 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.session import materialize


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, also inside lambdas."""
    return F.transform(F.array(value), then)[0]


def window_hashes(units: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` consecutive strings of an array; null if there are fewer."""

    def runs(u: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(u) - length)
        return F.when(F.size(u) >= length, F.transform(starts, lambda i: F.xxhash64(*[F.get(u, i + k) for k in range(length)])))

    return let(units, runs)


def windows_of(units: Column, length: int) -> Column:
    """Windows (hash, n) of ``length`` units from every unit that has enough after it."""
    return F.transform(window_hashes(units, length), lambda h: F.struct(h.alias("hash"), F.lit(length).alias("n")))


def long_windows_of(units: Column, least: int, words: int) -> Column:
    """From every unit the shortest window (hash, n) of at least ``least`` units and ``words`` words; a null hash if there is none."""
    sized = F.transform(units, lambda u: F.struct(u.alias("u"), F.regexp_count(u, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("w")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("hash"))

    def enough(run: Column) -> Column:
        return (run["n"] >= least) & (run["w"] >= words)

    def longer(run: Column, unit: Column) -> Column:
        more = F.struct((run["n"] + 1).alias("n"), (run["w"] + unit["w"]).alias("w"), F.xxhash64(run["hash"], unit["u"]).alias("hash"))
        return F.when(enough(run), run).otherwise(more)

    def finish(run: Column) -> Column:
        return F.struct(F.when(enough(run), run["hash"]).alias("hash"), run["n"].alias("n"))

    # a unit has a word at least, so this many are always enough
    reach = max(least, words)
    return let(sized, lambda all_: F.transform(all_, lambda _, i: F.aggregate(F.slice(all_, i + 1, reach), start, longer, finish)))


def full(pieces: Column, key) -> Column:
    """Keys of the pieces that are not blank; windows run over these."""
    return F.filter(F.transform(pieces, key), lambda k: k != "")


def without(pieces: Column, key, covered: Column) -> Column:
    """Pieces that stay: blank ones, and full ones whose number among the full ones is not covered."""

    def cut(found: Column) -> Column:
        numbers = F.filter(F.transform(found, lambda piece, i: F.when(key(piece) == "", -1).otherwise(i)), lambda i: i >= 0)
        gone = let(numbers, lambda places: F.transform(covered, lambda c: F.get(places, c)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), gone)
        return F.transform(stay, lambda i: F.get(found, i))

    return let(pieces, cut)


def later_copies(docs: DataFrame, id_column: str, windows: Column) -> DataFrame:
    """Rows (id, covered): the sorted places of the units that a later copy of a repeated window covers.

    Only documents with such units have a row. ``windows`` is an array of (hash, n), one for each unit in order; a window
    covers the ``n`` units from its own on, and one without a hash is left out. Rows with a null identifier are left out;
    rows that share an identifier count as one document.
    """
    found = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.posexplode(windows).alias("at", "w"))
    found = materialize(found.select("id", "at", "w.hash", "w.n").where(F.col("hash").isNotNull()), "windows")
    place = F.struct("id", "at")
    firsts = found.groupBy("hash").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
    firsts = materialize(firsts.select("hash", "first"), "windows")
    later = found.join(firsts, "hash").where(place != F.col("first"))
    covered = F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("n") - 1)))
    return later.groupBy("id").agg(F.array_sort(F.array_distinct(covered)).alias("covered")).withColumnRenamed("id", id_column)
