"""Spelling variants: words one edit apart, found by search schemes over FM-indexes of the vocabulary.

Two words are near if they differ by one inserted, deleted or replaced code point. Cut a word into a left and a right half: the edit
lies in one of them, so the other stands unchanged at the same end of the near word. Hence two schemes: match the left half
exactly and extend to the right over the other half allowing one edit, or match the right half and extend to the left.

The vocabulary is dealt in shards twice: as ranges of the words in order for extension to the right, and as ranges of the
reversed words for extension to the left. A word is sent to the shards whose range its exact half falls in, mostly one. In a shard
the words stand in one delimited text, indexed for the direction of extension: interval bounds of suffix ranks move by one symbol with two
binary searches, for many words at once. Shards have about ``SHARD`` words; words that search one shard come in blocks of about ``SHARD`` as
well, so neither a common beginning nor a common ending makes a large group.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.llm import crc, vec
from hashgrove.session import materialize

#: Everything but the letters of a run, which are in lower case where they are ASCII; fixed by the definition of a word.
SEPARATORS = r"[^A-Za-z\x{C0}-\x{FF}]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
DELETED_ONE_IN = 97
RATIO = 2
SHARD = 20_000
AT_ONCE = 2_048
END, BORDER = 0, 1  # symbols: the end of the text, and what stands around each word


def _dropped(words: list[str], hashes: np.ndarray, least: int) -> list[str]:
    """Words without the code point that their hash names, if they stay long enough."""
    cut = [w[: h % len(w)] + w[h % len(w) + 1 :] for w, h in zip(words, hashes.tolist(), strict=True)]
    return [w for w in cut if len(w) >= least]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_LENGTH, deleted_one_in: int = DELETED_ONE_IN) -> DataFrame:
    """Rows (word, n) of all words of at least ``least`` code points.

    Words are maximal runs of Latin letters with A-Z in lower case. Where ``deleted_one_in`` divides the CRC-32 h of
    ``<doc_id>:<run>`` the code point h modulo the run's length is left out first. A null identifier is empty here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, _, _ in vec.pieces(batch.column(1), 4 * vec.PIECE):
                different, at, bounds = crc.words(batch.column(1).slice(first, last - first), SEPARATORS)
                check, size = crc.of_strings(different)
                start = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in names[first:last]], np.uint32)
                hashes = crc.append(np.repeat(start, np.diff(bounds)), check[at], size[at])
                hit = hashes % deleted_one_in == 0
                n = np.bincount(at[~hit], minlength=len(different))
                some = (n > 0) & (pc.utf8_length(different).to_numpy(zero_copy_only=False) >= least)
                yield pa.RecordBatch.from_arrays([different.filter(pa.array(some)), pa.array(n[some])], names=["word", "n"])
                cut = _dropped(different.take(pa.array(at[hit])).to_pylist(), hashes[hit], least)
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), pa.array(np.ones(len(cut), np.int64))], names=["word", "n"])

    found = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return found.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """FM-index of a delimited text of words, for matching them from their first symbol on.

    The words stand reversed, so that a step of backward search goes on by one symbol of the word. ``keys`` holds, for every row of
    the suffix array, its preceding symbol and its rank, in order; the rank of (symbol, row) in it is where the interval moves to.
    """

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w[::-1].encode("utf-32-le", "surrogatepass"), "<u4") for w in words]
        flat = np.concatenate([np.empty(0, "<u4"), *points])
        sizes = np.array([len(p) for p in points], np.int64)
        self.alphabet = np.unique(flat)
        # every word is followed by a border, the first one also comes behind one
        self.borders = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.full(int(self.borders[-1]) + 2, BORDER, np.int64)
        text[vec.ragged(self.borders[:-1] + 1, sizes)] = np.searchsorted(self.alphabet, flat) + 2
        text[-1] = END
        self.n, self.symbols = len(text), len(self.alphabet) + 2
        self.suffixes = self._sorted_suffixes(text, self.symbols)
        self.before = text[self.suffixes - 1]
        by_symbol = np.argsort(self.before, kind="stable")
        self.keys = self.before[by_symbol] * self.n + by_symbol

    @staticmethod
    def _sorted_suffixes(text: np.ndarray, symbols: int) -> np.ndarray:
        """Suffix array by doubling, from as many symbols as fit one number."""
        n, bits = len(text), max(1, (symbols - 1).bit_length())
        step = 62 // bits
        packed = np.zeros(n, np.int64)
        for k in range(min(step, n)):
            packed[: n - k] |= text[k:] << (bits * (step - 1 - k))
        _, rank = np.unique(packed, return_inverse=True)
        while rank.max() < n - 1:
            later = np.zeros(n, np.int64)
            later[: max(0, n - step)] = rank[step:] + 1
            _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return order

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; one that no word has is a symbol that never matches."""
        at = np.minimum(np.searchsorted(self.alphabet, points), max(0, len(self.alphabet) - 1))
        known = self.alphabet[at] == points if len(self.alphabet) else np.zeros(len(points), bool)
        return np.where(known, at + 2, self.symbols)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffix ranks after one more symbol."""
        return np.searchsorted(self.keys, symbol * self.n + low), np.searchsorted(self.keys, symbol * self.n + high)

    def followers(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different symbols of words that go on from each interval: the interval's number and the symbol."""
        wide = np.flatnonzero(high - low > self.symbols)
        narrow = np.flatnonzero(high - low <= self.symbols)
        size = (high - low)[narrow]
        seen = np.unique(np.repeat(narrow, size) * self.symbols + self.before[vec.ragged(low[narrow], size)])
        number, symbol = np.divmod(np.concatenate([seen, (wide[:, None] * self.symbols + np.arange(self.symbols)).ravel()]), self.symbols)
        return number[symbol > BORDER], symbol[symbol > BORDER]

    def word_of(self, low: np.ndarray) -> np.ndarray:
        """Words that whole matches, borders at both ends, stand for."""
        return np.searchsorted(self.borders, self.suffixes[low])


def search(index: Index, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of a searched word, number of an index word) one edit apart behind the first ``exact`` symbols, each once."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    # a border ends each word, so that reading on is always possible
    codes, start = np.full(len(flat) + len(words) + 1, BORDER, np.int64), np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    codes[vec.ragged(start, sizes)] = index.codes(flat)
    pairs = []

    def finish(word: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Read the rest of the words from ``at`` on, up to and with the border."""
        while len(word):
            low, high = index.step(low, high, codes[start[word] + at])
            done = at == sizes[word]
            met = done & (high > low)
            pairs.append((word[met], index.word_of(low[met])))
            on = ~done & (high > low)
            word, at, low, high = word[on], at[on] + 1, low[on], high[on]

    low, high = index.step(np.zeros(len(words), np.int64), np.full(len(words), index.n), BORDER)
    word, at = np.arange(len(words)), np.zeros(len(words), np.int64)
    while len(word):
        own = codes[start[word] + at]
        edit = np.flatnonzero(at >= exact[word])
        # of a run of equal symbols the last one is left out, and one more comes behind the run: each pair has one way
        last = edit[(at[edit] < sizes[word[edit]]) & (codes[start[word[edit]] + at[edit] + 1] != own[edit])]
        finish(word[last], at[last] + 1, low[last], high[last])
        number, symbol = index.followers(low[edit], high[edit])
        number = edit[number]
        other = symbol != own[number]
        number, symbol = number[other], symbol[other]
        new_low, new_high = index.step(low[number], high[number], symbol)
        some = new_high > new_low
        number, new_low, new_high = number[some], new_low[some], new_high[some]
        finish(word[number], at[number], new_low, new_high)
        inside = at[number] < sizes[word[number]]
        finish(word[number[inside]], at[number[inside]] + 1, new_low[inside], new_high[inside])
        low, high = index.step(low, high, own)
        on = (high > low) & (at < sizes[word])
        word, at, low, high = word[on], at[on] + 1, low[on], high[on]
    return tuple(np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2


def _best(words: list[str], counts: np.ndarray, found: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` searched words the number of near ones, and the one with the largest count, ties to the first in order."""
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    who, near = found
    order = np.lexsort((place[near], -counts[near], who))
    first = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
    best = np.full(n, -1, np.int64)
    best[who[first]] = near[first]
    return np.bincount(who, minlength=n), best


def _in_shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """Near words that one shard (word, n, side) has for the words (word, side) sent to it."""
    words, sent = left.column("word").to_pylist(), right.column("word").to_pylist()
    names = ["word", "n_near", "best_n", "best"]
    if not words or not sent:
        return pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=names)
    back = left.column("side")[0].as_py() == 1
    counts = left.column("n").to_numpy()
    index = Index([w[::-1] for w in words] if back else words)
    near, best = [], []
    for i in range(0, len(sent), AT_ONCE):
        part = sent[i : i + AT_ONCE]
        half = np.array([len(w) // 2 for w in part], np.int64)
        if back:
            who, found = search(index, [w[::-1] for w in part], np.array([len(w) for w in part], np.int64) - half)
            # what begins with the whole left half is found in the other direction
            own = np.array([not words[f].startswith(part[q][: len(part[q]) // 2]) for q, f in zip(who.tolist(), found.tolist(), strict=True)], bool)
            who, found = who[own], found[own]
        else:
            who, found = search(index, part, half)
        a, b = _best(words, counts, (who, found), len(part))
        near.append(a)
        best.append(b)
    near, best = np.concatenate(near), np.concatenate(best)
    some = np.flatnonzero(near)
    picked = best[some]
    return pa.table([pa.array([sent[i] for i in some.tolist()], pa.string()), pa.array(near[some]), pa.array(counts[picked]), pa.array([words[i] for i in picked.tolist()], pa.string())], names=names)


def _sides(words: DataFrame, n: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """The vocabulary dealt in shards, and the words as sent to them: rows (side, shard, block, word, n) and (side, shard, block, word)."""
    own, sent = [], []
    for side, key in ((0, F.col("word")), (1, F.reverse("word"))):
        dealt = words.withColumn("key", key).repartitionByRange(max(1, -(-n // shard)), "key").withColumn("shard", F.spark_partition_id())
        dealt = materialize(dealt, "shards")
        # one row for each shard
        ends = dealt.groupBy("shard").agg(F.min("key").alias("least"), F.max("key").alias("most")).orderBy("shard").collect()
        bounds = words.sparkSession.sparkContext.broadcast(([r["shard"] for r in ends], [r["least"].encode() for r in ends], [r["most"].encode() for r in ends]))

        def route(batches: Iterator[pa.RecordBatch], side: int = side, bounds=bounds) -> Iterator[pa.RecordBatch]:
            numbers, least, most = bounds.value
            for batch in batches:
                rows, shards = [], []
                for i, word in enumerate(batch.column(0).to_pylist()):
                    half = len(word) // 2
                    part = (word[:half] if side == 0 else word[half:][::-1]).encode()
                    # no UTF-8 text has the byte FF
                    for k in range(bisect.bisect_left(most, part), bisect.bisect_right(least, part + b"\xff")):
                        rows.append(i)
                        shards.append(numbers[k])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(shards, pa.int32())], names=["word", "shard"])

        routed = materialize(words.select("word").mapInArrow(route, "word string, shard int"), "routed")
        blocks = routed.groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
        blocks = materialize(blocks, "blocks")
        own.append(dealt.join(blocks, "shard").select(F.lit(side).alias("side"), "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n"))
        sent.append(routed.join(blocks, "shard").select(F.lit(side).alias("side"), "shard", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), "word"))
    return own[0].union(own[1]), sent[0].union(sent[1])


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows (word, n_near, best_n, best) of the words that have near ones, for a written table of different (word, n).

    ``best`` is the near word of the largest n, the first in code-point order among equals.
    """
    own, sent = _sides(words, words.count(), shard)
    group = ["side", "shard", "block"]
    found = own.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(_in_shard, "word string, n_near bigint, best_n bigint, best string")
    pick = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("best"))).alias("pick")
    total = materialize(found, "near").groupBy("word").agg(F.sum("n_near").alias("n_near"), pick)
    return total.select("word", "n_near", (-F.col("pick.order")).alias("best_n"), F.col("pick.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of the words that have a form: where following forms ends. Each round doubles the way."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        step = materialize(up.join(higher, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return up


def spelling_variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    deleted_one_in: int = DELETED_ONE_IN,
    shard: int = SHARD,
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of every word that occurs at least ``least_count`` times.

    A word's form is its near word of the largest n (ties: the first in code-point order) if that n is at least ``ratio`` (2 or more) times
    its own, else null; the root is where following forms ends, the word itself without one. Null and empty texts and
    texts without letters have no words; rows that share an identifier count each on their own, and repeated rows count
    again. An empty table gives an empty result. Other columns are not looked at.
    """
    if ratio < 2:
        raise ValueError("following forms ends for ratios of 2 and more only")
    counted = word_counts(docs, text, doc_id, least_length, deleted_one_in)
    words = materialize(counted.where(F.col("n") >= least_count), "words")
    near = near_words(words, shard)
    clear = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")
    )
    formed = materialize(joined, "forms")
    roots = _roots(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
