"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled web text. A small network minimises the
non-negative unbiased risk: with class prior p, the risk of the negatives is taken as the unlabelled texts' risk minus p
times the positives', and is kept from going below zero. The prior is estimated from the same sample: p bounds the ratio
of the unlabelled to the positive texts in any region, so it is the least such ratio over the upper tails of a first
classifier's scores. Labels other than good are not read.

Features are measures of whole texts: shares of character kinds, lengths of words and lines, repetition of words, pairs
of words and lines, line endings. They are worked out on arrays of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.llm import vec
from hashgrove.session import materialize

MAX_SAMPLE = 20_000
HIDDEN = 16
NAMES = (
    "log_bytes", "log_words", "log_lines", "bytes_per_word", "words_per_line", "upper", "lower", "digit", "beyond_ascii",
    "stop", "comma", "other_mark", "symbol", "bar", "exclaim", "words_ending_odd", "words_all_caps", "words_capital", "words_one_byte",
    "words_same_as_last", "words_new", "pairs_new", "lines_new", "lines_unended", "words_with_symbol", "long_words",
)
_KIND = np.zeros(256, np.uint8)
UPPER, LOWER, DIGIT, BEYOND, STOP, COMMA, MARK, SYMBOL, BAR, EXCLAIM = range(1, 11)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = UPPER, LOWER, DIGIT, BEYOND
for _kind, _chars in ((STOP, ".?"), (COMMA, ","), (MARK, ";:'\"()-[]{}/"), (SYMBOL, "#*$%&<>@^~=+_\\`"), (BAR, "|"), (EXCLAIM, "!")):
    _KIND[[ord(c) for c in _chars]] = _kind


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of measures for each document; zeros for an empty one."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    sizes = np.diff(offsets)
    out[:, 0] = np.log1p(sizes)
    starts, ends = vec.spans(~vec.SPACE[data], offsets)
    if not len(starts):
        return out
    kind = _KIND[data]
    document = np.repeat(np.arange(n), sizes)
    chars = np.maximum(1, np.bincount(document[kind > 0], minlength=n))
    by_kind = np.bincount(document * 11 + kind, minlength=n * 11).reshape(n, 11)[:, 1:] / chars[:, None]
    out[:, 5:15] = by_kind
    own = document[starts]
    words = np.bincount(own, minlength=n)
    some = np.maximum(1, words)
    lengths = ends - starts

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(own[flags], minlength=n) / some

    def prefix(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total

    upper, symbol = prefix(kind == UPPER), prefix((kind == SYMBOL) | (kind == BAR) | (kind == EXCLAIM))
    last, first = kind[ends - 1], kind[starts]
    out[:, 1] = np.log1p(words)
    out[:, 3] = np.bincount(own, lengths, minlength=n) / some
    out[:, 15] = share((last >= SYMBOL) & (lengths > 1))
    out[:, 16] = share((upper[ends] - upper[starts] >= 2) & (upper[ends] - upper[starts] >= 0.6 * lengths))
    out[:, 17] = share(first == UPPER)
    out[:, 18] = share(lengths == 1)
    out[:, 24] = share(symbol[ends] > symbol[starts])
    out[:, 25] = share(lengths > 20)
    hashes = vec.span_hashes(data, starts, ends)
    same_doc = own[1:] == own[:-1]
    again = np.zeros(len(own), bool)
    again[1:] = same_doc & (hashes[1:] == hashes[:-1])
    out[:, 19] = share(again)

    def fresh(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Share of different keys in each document."""
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n) / np.maximum(1, np.bincount(owner, minlength=n))

    out[:, 20] = fresh(hashes, own)
    pairs = vec.mixed(hashes[:-1] + vec.mixed(hashes[1:]))[same_doc]
    out[:, 21] = fresh(pairs, own[1:][same_doc])
    line_starts, line_ends = vec.spans(data != 10, offsets)
    line_own = document[line_starts]
    lines = np.bincount(line_own, minlength=n)
    out[:, 2] = np.log1p(lines)
    out[:, 4] = np.log1p(words / np.maximum(1, lines))
    out[:, 22] = fresh(vec.span_hashes(data, line_starts, line_ends), line_own)
    out[:, 23] = np.bincount(line_own[kind[line_ends - 1] != STOP], minlength=n) / np.maximum(1, lines)
    out[words == 0, 1:] = 0
    return out


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and an array column of features of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in vec.pieces(batch.column(0)):
                found = features(data, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(k + 1).slice(first, last - first) for k in range(len(columns))] + [lists], names=[*columns, "x"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select("text", *columns).mapInArrow(run, f"{fields}, x array<double>")


@dataclass(frozen=True)
class Network:
    """One hidden layer over standardised features; ``prior`` is the estimated share of good texts."""

    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    prior: float

    def outputs(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w + b) @ v + c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.outputs(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 2500, batch: int = 512, seed: int = 7) -> Network:
    """Minimise the non-negative unbiased risk under the logistic loss with Adam.

    Without a prior the plain classifier of positive against unlabelled texts is trained, both weighing the same.
    """
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    layers = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        hp, hu = np.tanh(xp @ layers[0] + layers[1]), np.tanh(xu @ layers[0] + layers[1])
        zp, zu = hp @ layers[2] + layers[3], hu @ layers[2] + layers[3]
        # derivatives of log(1 + exp(-z)) for the positive label and of log(1 + exp(z)) for the negative one
        as_positive, as_negative, spread = -_sigmoid(-zp) / batch, _sigmoid(zp) / batch, _sigmoid(zu) / batch
        if prior is None:
            gp, gu = as_positive, spread
        else:
            negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative_risk >= 0:
                gp, gu = prior * as_positive - prior * as_negative, spread
            else:  # go back up instead of fitting an impossible risk
                gp, gu = prior * as_negative, -spread
        pace = 0.005 * (1 + np.cos(np.pi * step / steps))
        x, h, g = np.vstack([xp, xu]), np.vstack([hp, hu]), np.concatenate([gp, gu])
        back = np.outer(g, layers[2]) * (1 - h * h)
        slopes = [x.T @ back + 1e-4 * layers[0], back.sum(0), h.T @ g + 1e-4 * layers[2], np.array([g.sum()])]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope * slope
            layers[k] = layers[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, tuple(layers), 1.0 if prior is None else prior)


def tails(positive: np.ndarray, least_share: float = 0.1) -> np.ndarray:
    """Ascending scores whose upper tails hold at least ``least_share`` of the positives."""
    return np.quantile(positive, np.linspace(0.0, 1 - least_share, 60))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Upper bound of the share of positives among the unlabelled, from the shares of either (``unlabelled``) in the tails of ``positive`` scores."""
    p = np.array([(positive >= c).mean() for c in tails(positive)])
    return float(np.clip((unlabelled / p).min(), 0.05, 0.99))


def tail_shares(named: DataFrame, rough: Network, cuts: np.ndarray) -> np.ndarray:
    """Share of all documents (id, text) whose output is at least each of the cuts; rows that share an identifier count once, by their greatest output."""
    sent = named.sparkSession.sparkContext.broadcast((rough, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bounds = sent.value
        for batch in batches:
            for first, last, data, offsets in vec.pieces(batch.column(1)):
                reached = np.searchsorted(bounds, model.outputs(features(data, offsets)), "right")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(reached.astype(np.int32))], names=["id", "reached"])

    kind = named.schema["id"].dataType.simpleString()
    each = named.select("id", "text").mapInArrow(run, f"id {kind}, reached int").groupBy("id").agg(F.max("reached").alias("reached"))
    # one row for each number of cuts reached
    counts = np.zeros(len(cuts) + 1)
    for row in each.groupBy("reached").agg(F.count("*").alias("n")).collect():
        counts[row["reached"]] = row["n"]
    return counts[::-1].cumsum()[::-1][1:] / max(1, counts.sum())


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", max_sample: int = MAX_SAMPLE) -> Network | None:
    """Train on the documents whose identifiers are in ``trusted`` and on unlabelled documents.

    At most ``max_sample`` documents of either kind are learned from, those with the least hashes of their identifiers; the share of good
    ones is estimated over all documents. Rows that share an identifier count as one document, the one with the least text. Null identifiers are
    left out. None without any trusted or other document.
    """
    named = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id")).where(F.col("id").isNotNull())
    good = materialize(trusted.select(F.col(doc_id).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_sample), "trusted")
    # all documents are unlabelled text, the trusted ones among them
    web = materialize(named.select("id").distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_sample), "unlabelled")
    # proven bound: 2 * max_sample rows of two numbers
    chosen = materialize(good.withColumn("y", F.lit(1)).union(web.withColumn("y", F.lit(0))), "sample")
    one = named.join(F.broadcast(chosen.select("id").distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
    rows = materialize(_measured(one.join(F.broadcast(chosen), "id"), ["y", "id"]), "features")
    # one row of some features for each row of the sample comes to the driver, in a fixed order
    arrow = rows.orderBy("y", F.xxhash64("id"), "id").toArrow()
    y = arrow.column("y").to_numpy()
    x = np.array(arrow.column("x").to_pylist(), float).reshape(len(y), len(NAMES))
    positive, unlabelled = x[y == 1], x[y == 0]
    if not len(positive) or not len(unlabelled):
        return None
    # one half trains the first classifier, the other half of the positives and all documents measure the tails
    half_p, half_u = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
    if min(half_p.sum(), (~half_p).sum(), half_u.sum()) >= 20:
        rough = train(positive[half_p], unlabelled[half_u], None)
        known = rough.outputs(positive[~half_p])
        prior = estimate_prior(known, tail_shares(named, rough, tails(known)))
    else:
        prior = 0.5
    return train(positive, unlabelled, prior)


def score(docs: DataFrame, network: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (id, score in 0 .. 1) for every row; texts are read whole, a null text as an empty one. 0.5 without a network."""
    if network is None:
        return docs.select(doc_id, F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, last, data, offsets in vec.pieces(batch.column(1)):
                found = model.scores(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(found)], names=["id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", doc_id)
