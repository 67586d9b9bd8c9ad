"""Importance resampling towards a target distribution, over hashed word n-grams.

Each run of one to three words is a feature; its bucket is the CRC-32 of its bytes modulo ``BUCKETS``. A bucket's gain is
the logarithm of the target's smoothed share over the corpus's. A document's weight is the sum of its features' gains; with Gumbel
noise, made from its identifier, the largest scores are a draw without replacement in proportion to the weights' exponentials.

Texts are read twice, for counts and for weights, in Arrow kernels: a text is lower-cased and split by a pattern, the lists are
flattened and dictionary-encoded; indices shifted by one and two places make codes of pairs and triples, which are dictionary-encoded in turn. Only
different words, pairs and triples get a CRC-32, the longer ones from those of their parts; gains are taken by index and summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.llm import crc, vec
from hashgrove.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Everything but ASCII letters, ASCII digits and characters beyond ASCII; fixed by the definition of a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = np.uint32(0xE96CCF45)  # CRC-32 of one blank
_PLACE = 33  # bits of a row's number within its partition


def _grams(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Number of words of each text; for runs of one, two and three words the buckets of the different ones, the index of each run among them, and its text."""
    different, at, bounds = crc.words(texts, SEPARATORS)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first, size = crc.of_strings(different)
    blank = crc.append(np.full(len(first), _BLANK), first, size)
    checks, grams = first, [((first % BUCKETS).astype(np.int64), at, row)]
    runs = at
    for step in (1, 2):
        # both ends in one text
        inside = row[step:] == row[:-step] if len(row) > step else np.zeros(0, bool)
        codes = (runs[: len(inside)] * len(different) + at[step : step + len(inside)])[inside]
        encoded = pa.array(codes).dictionary_encode()
        codes = encoded.dictionary.to_numpy(zero_copy_only=False)
        left, right = np.divmod(codes, max(1, len(different)))
        checks = crc.append(checks[left], blank[right], size[right] + 1)
        found = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        grams.append(((checks % BUCKETS).astype(np.int64), found, row[: len(inside)][inside]))
        # a run that ends its text begins no longer one, so its index does not matter
        runs = np.zeros(len(inside), np.int64)
        runs[inside] = found
    return np.diff(bounds), grams


def feature_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (bucket, n): features of all texts by bucket, repeats counted. Each task sends one row for each bucket it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for first, last, _, _ in vec.pieces(batch.column(0)):
                for buckets, found, _ in _grams(batch.column(0).slice(first, last - first))[1]:
                    # a sum of whole numbers far below 2**53
                    total += np.bincount(buckets, np.bincount(found, minlength=len(buckets)), BUCKETS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> DataFrame:
    """Rows (bucket, s, t, gain) for every bucket: features of the corpus and of the target, and the gain in thousandths, rounded down."""
    buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    s = feature_counts(docs, text).withColumnRenamed("n", "s")
    t = feature_counts(target, target_text).withColumnRenamed("n", "t")
    both = materialize(buckets.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]), "gains")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(all_s + BUCKETS))) / ((s + 1) * F.lit(float(all_t + BUCKETS)))
    return both.select("bucket", "s", "t", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, table: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (id, n_words, n_features, weight) for every row; the weight is the sum of the gains of ``table`` over the features."""
    gain = np.zeros(BUCKETS, np.int64)
    rows = table.select("bucket", "gain").toArrow()  # BUCKETS rows
    gain[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for first, last, _, _ in vec.pieces(batch.column(1)):
                counts, grams = _grams(batch.column(1).slice(first, last - first))
                weight = np.zeros(len(counts), np.int64)
                for buckets, found, row in grams:
                    if len(found):
                        starts = np.flatnonzero(np.diff(row, prepend=-1))
                        weight[row[starts]] += np.add.reduceat(own[buckets][found], starts)
                features = counts + np.maximum(counts - 1, 0) + np.maximum(counts - 2, 0)
                columns = [batch.column(0).slice(first, last - first), pa.array(counts), pa.array(features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return out.withColumnRenamed("id", doc_id)


def noise(identifier: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of ``<seed>:<identifier>``; a null identifier is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` 1, 2, 3 ... in this total order, and how many rows there are.

    Rows are range-partitioned and sorted within their partitions, so no task has more than its range; only the partitions' sizes are summed up.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked").withColumn("_part", F.shiftright("_at", _PLACE))
    # one row for each partition
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select("_part", "_n", before.alias("_before")), "ranked")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    own = F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return placed.join(F.broadcast(sizes), "_part").withColumn("rank", F.col("_before") + own + 1).drop("_at", "_part", "_n", "_before"), total


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Rows (id, n_features, weight, score, rank) for every row of ``docs``; ``rank`` is null for those that are not drawn.

    Of the N rows with at least ``min_words`` words the ``percent * N / 100`` (rounded down) of the highest scores are drawn, ties
    to the smaller identifier, null identifiers last. Null and empty texts have no features and the weight 0. Rows that share an
    identifier share its noise and are drawn each on its own. Without a target every gain is that of an empty one; an
    empty table gives an empty result. Other columns are not looked at.
    """
    weighed = weigh(docs, gains(docs, target, text, target_text), text, doc_id).withColumnRenamed(doc_id, "id")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("place", F.monotonically_increasing_id())
    scored = materialize(scored, "scores")
    # the place in the written table tells equal rows apart, so that a repeated identifier is no hot range
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight"), F.asc("place")]
    pool, n = ranked(scored.where(F.col("n_words") >= min_words), order)
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    columns = ["id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return pool.select(*columns, drawn.alias("rank")).union(rest).withColumnRenamed("id", doc_id)
