"""Language identification by a convolutional network over bytes.

Bytes have learned vectors; filters of several widths run over them, the greatest value of each filter in a window is kept, and a softmax
layer gives the window's probabilities. Texts are cut whole into windows of ``LENGTH`` positions (a filter may look into the next
window's first bytes); a document's probabilities are the mean of its windows', weighted by their bytes. Training is plain
numpy on windows of a bounded sample of labelled texts, the same number of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.llm import vec
from hashgrove.session import materialize

UNKNOWN = "und"
MAX_SAMPLE = 8_000
MAX_LANGUAGES = 1_000
WINDOWS = 4
LENGTH = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12  # of each width
VECTOR = 8
WIDEST = max(WIDTHS)
ROW = LENGTH + WIDEST - 1  # bytes of a window; a multiple of the widest filter
AT_ONCE = 512  # windows
_OPEN = np.arange(WIDEST * VECTOR)[:, None] < np.repeat(WIDTHS, FILTERS) * VECTOR  # narrower filters end before the widest


def windows(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of windows that begin at ``first``; a window has ``size`` bytes left in its text, and zeros stand behind it."""
    step = np.arange(ROW)
    at = np.minimum(first[:, None] + step, max(0, len(data) - 1))
    return np.where(step < size[:, None], data[at], 0).astype(np.uint8) if len(data) else np.zeros((len(first), ROW), np.uint8)


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDEST * VECTOR x filters
    lift: np.ndarray
    out: np.ndarray
    out_lift: np.ndarray

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The greatest value of each filter in each window."""
        flat = self.vectors[rows].ravel()
        best = None
        # positions that are WIDEST apart have neither a byte in common nor one between them: they are rows of one matrix as it lies in memory
        for shift in range(WIDEST):
            full = (len(flat) - shift * VECTOR) // (WIDEST * VECTOR)
            found = flat[shift * VECTOR :][: full * WIDEST * VECTOR].reshape(full, -1) @ self.filters
            each = ROW // WIDEST
            if full < len(rows) * each:  # the last window's last place lacks bytes, and is left out anyway
                found = np.vstack([found, found[:1]])
            top = found.reshape(len(rows), each, -1)[:, : len(range(shift, LENGTH, WIDEST))].max(1)
            best = top if best is None else np.maximum(best, top)
        return np.maximum(best + self.lift, 0)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.pooled(rows) @ self.out + self.out_lift
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of whole texts; zeros for an empty one. Windows are held ``AT_ONCE`` at a time."""
        sizes = np.diff(offsets)
        counts = -(-sizes // LENGTH)
        total = np.zeros((len(sizes), len(self.languages)))
        row = np.repeat(np.arange(len(sizes)), counts)
        place = vec.ragged(np.zeros(len(sizes), np.int64), counts) * LENGTH
        for i in range(0, len(row), AT_ONCE):
            own, at = row[i : i + AT_ONCE], place[i : i + AT_ONCE]
            left = sizes[own] - at
            weighed = self.probabilities(windows(data, offsets[own] + at, left)) * np.minimum(left, LENGTH)[:, None]
            np.add.at(total, own, weighed)
        return total / np.maximum(sizes, 1)[:, None]


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 900, batch: int = 64, seed: int = 3) -> Network:
    """Minimise the cross entropy of windows' languages with Adam."""
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        (rng.normal(0, 1 / np.sqrt(WIDEST * VECTOR), (WIDEST * VECTOR, n)) * _OPEN).astype(np.float32),
        np.zeros(n, np.float32),
        rng.normal(0, 1 / np.sqrt(n), (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    parts = [net.vectors, net.filters, net.lift, net.out, net.out_lift]
    first, second = [np.zeros_like(w) for w in parts], [np.zeros_like(w) for w in parts]
    each = np.arange(batch)[:, None]
    for step in range(1, steps + 1):
        picked = rng.integers(0, len(rows), batch)
        x, y = rows[picked], labels[picked]
        seen = net.vectors[x]
        patches = np.ascontiguousarray(np.lib.stride_tricks.as_strided(seen, (batch, LENGTH, WIDEST * VECTOR), (seen.strides[0], seen.strides[1], seen.strides[2])))
        found = patches.reshape(-1, WIDEST * VECTOR) @ net.filters
        found = found.reshape(batch, LENGTH, n)
        at = found.argmax(1)
        pooled = np.take_along_axis(found, at[:, None], 1)[:, 0] + net.lift
        h = np.maximum(pooled, 0)
        z = h @ net.out + net.out_lift
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        back = (p @ net.out.T) * (pooled > 0)
        own = patches[each, at]  # windows x filters x patch
        along = (back[:, :, None] * net.filters.T).reshape(-1, VECTOR)
        met = x[each[:, :, None], at[:, :, None] + np.arange(WIDEST)].ravel()
        slopes = [
            np.stack([np.bincount(met, along[:, k], 256) for k in range(VECTOR)], 1),
            np.einsum("bfk,bf->kf", own, back) * _OPEN,
            back.sum(0),
            h.T @ p + 1e-4 * net.out,
            p.sum(0),
        ]
        pace = 0.005 * (1 + np.cos(np.pi * step / steps))
        for k, slope in enumerate(slopes):
            first[k] += 0.1 * (slope.astype(np.float32) - first[k])
            second[k] += 0.001 * (slope.astype(np.float32) ** 2 - second[k])
            parts[k] -= np.float32(pace) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows (id, lang), as many of each language: those with the least hashes of their identifiers."""
    kinds = labelled.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    kinds = materialize(kinds, "languages")
    known = kinds.count()
    if known > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = most // max(1, known)
    # about four times as many as are needed, so that no language gathers in one task
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * 4 * each / F.col("n")
    some = labelled.join(F.broadcast(kinds), "lang").where(part).select("lang", "id").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    return materialize(some.withColumn("_place", place).where(F.col("_place") <= each).select("lang", "id"), "sample")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_sample: int = MAX_SAMPLE) -> Network | None:
    """Train on the texts of ``docs`` that have a language; None if there is none with a letter.

    At most ``max_sample`` texts in all are learned from, as many of each language, with up to ``WINDOWS`` windows spread over each text. Rows that
    share an identifier and a language count as one, the one with the least text; rows with a null identifier are left out.
    """
    named = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    named = named.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = _sample(named, max_sample)
    # proven bound: max_sample rows
    texts = named.join(F.broadcast(chosen), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.buffers(batch.column(2))
            sizes = np.diff(offsets)
            counts = -(-sizes // LENGTH)
            taken = np.minimum(counts, WINDOWS)
            row = np.repeat(np.arange(len(sizes)), taken)
            k = vec.ragged(np.zeros(len(sizes), np.int64), taken)
            at = (2 * k + 1) * counts[row] // (2 * taken[row]) * LENGTH
            found = windows(data, offsets[row] + at, sizes[row] - at)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ROW), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(k), packed], names=["lang", "id", "k", "window"])

    kind = named.schema["id"].dataType.simpleString()
    rows = materialize(texts.select("lang", "id", "text").mapInArrow(cut, f"lang string, id {kind}, k bigint, window binary"), "windows")
    # max_sample * WINDOWS rows of ROW bytes at most, in a fixed order
    arrow = rows.orderBy("lang", F.xxhash64("id"), "id", "k").select("lang", "window").toArrow()
    if not arrow.num_rows:
        return None
    labels = arrow.column("lang").combine_chunks().dictionary_encode()
    data = np.frombuffer(b"".join(arrow.column("window").to_pylist()), np.uint8).reshape(-1, ROW)
    return train(data, labels.indices.to_numpy(zero_copy_only=False), labels.dictionary.to_pylist())


def identify(docs: DataFrame, network: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (id, lang_pred, score) for every row: the likeliest language of the whole text, and its probability.

    A null text, one without a letter, and every text without a network is ``UNKNOWN`` with the score 0. An empty
    table gives an empty result; other columns are not looked at.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if network is None:
        return source.select(F.col("id").alias(doc_id), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            for first, last, data, offsets in vec.pieces(batch.column(1)):
                found = model.documents(data, offsets)
                columns = [batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), names.take(pa.array(found.argmax(1))), pa.array(found.max(1))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lettered", "lang_pred", "score"])

    kind = source.schema["id"].dataType.simpleString()
    out = source.select("id", "text", lettered.alias("lettered")).mapInArrow(run, f"id {kind}, lettered boolean, lang_pred string, score double")
    known = F.col("lettered")
    score = F.when(known, F.least(F.col("score"), F.lit(1.0))).otherwise(0.0)
    return out.select(F.col("id").alias(doc_id), F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"))
