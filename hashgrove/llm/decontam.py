"""Benchmark decontamination by greedy string tiling.

1. Seeds: every run of ``seed`` (five) tokens of a benchmark item. Their hashes set bits in a table of fixed size, which goes
   to all tasks; a window of a document whose bits are set is emitted, with the document's token hashes. The table only
   saves work: a full one would let more windows through, and the join that follows is exact.
2. Documents and items are joined on the hashes of the items' rarest seeds. A tile is made of seeds; the seeds left out, those that most
   documents have, cover less than the asked share of the item's tokens between them, so a document that covers the item has one of the others.
3. A pair goes on if the item's seeds that occur in the document cover enough of its tokens, and is tiled then: the longest common run of unmarked tokens is found by Karp-Rabin hashes of all windows (halving
   the range of lengths), all its non-overlapping matches are marked, and so on down to ``seed`` tokens. The order of
   tiles is free, so reordered passages are covered as well. Pairs covered enough are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.llm import vec
from hashgrove.session import materialize

SEED = 5
COVERAGE = 0.5
TABLE_BITS = 24
_PROBES = (np.uint64(0), np.uint64(TABLE_BITS + 4))


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with the hashes of their tokens and the bounds of each row's tokens.

    Tokens are runs of letters, digits and characters beyond ASCII, in lower case; punctuation and white space are left out.
    """
    for first, last, _, _ in vec.pieces(texts):
        data, offsets = vec.buffers(pc.utf8_lower(texts.slice(first, last - first)))
        starts, ends = vec.spans(vec.WORD[data], offsets)
        yield first, last, vec.span_hashes(data, starts, ends), vec.owners(starts, offsets)


def _seeds(tokens: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all token windows within one row, the row of each, and its place in the row."""
    hashes = vec.window_hashes(tokens, length)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(hashes)]
    inside = np.arange(len(hashes)) + length <= bounds[row + 1]
    at = np.flatnonzero(inside)
    return hashes[at], row[at], at - bounds[row[at]]


def _probe(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> shift) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64) for shift in _PROBES]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def benchmark_seeds(benchmark: DataFrame, item_id: str, text: str, seed: int) -> DataFrame:
    """Rows (item, tokens, seeds, row) of every item; both lists are hashes in order, ``row`` is its own. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, tokens, bounds in _tokens(batch.column(1)):
                hashes, row, _ = _seeds(tokens, bounds, seed)
                lists = [_lists(tokens, np.diff(bounds)), _lists(hashes, np.bincount(row, minlength=last - first))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], names=["item", "tokens", "seeds"])

    kind = benchmark.schema[item_id].dataType.simpleString()
    found = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    seeded = found.mapInArrow(run, f"item {kind}, tokens array<bigint>, seeds array<bigint>")
    return materialize(seeded.withColumn("row", F.monotonically_increasing_id()), "benchmark")


def _bit_table(items: DataFrame) -> np.ndarray:
    """Packed table of 2**TABLE_BITS bits; what is collected are the bits set, at most so many whatever the benchmark's size."""
    places = [F.col("s").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)), F.shiftrightunsigned("s", int(_PROBES[1])).bitwiseAND(F.lit((1 << TABLE_BITS) - 1))]
    rows = items.select(F.explode("seeds").alias("s")).select(F.explode(F.array(*places)).alias("bit")).distinct()
    bits = np.zeros(1 << TABLE_BITS, bool)
    for batch in rows.toArrow().column(0).chunks:
        bits[batch.to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def _met_seeds(docs: DataFrame, doc_id: str, text: str, table: np.ndarray, seed: int) -> DataFrame:
    """Rows (doc, tokens, seeds) of documents with windows in the table; seeds are those windows' different hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for first, _, tokens, bounds in _tokens(batch.column(1)):
                hashes, row, _ = _seeds(tokens, bounds, seed)
                met = np.ones(len(hashes), bool)
                for at in _probe(hashes):
                    met &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                pair = np.unique(np.stack([row[met].astype(np.uint64), hashes[met]]), axis=1)
                rows, counts = np.unique(pair[0].astype(np.int64), return_counts=True)
                if not len(rows):
                    continue
                sizes = np.diff(bounds)[rows]
                own = _lists(tokens[vec.ragged(bounds[rows], sizes)], sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + rows)), own, _lists(pair[1], counts)], names=["doc", "tokens", "seeds"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())
    return materialize(found.mapInArrow(run, f"doc {kind}, tokens array<bigint>, seeds array<bigint>"), "seeds")


def _longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, least: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Greatest length in least .. most of a common run of free tokens (0 if there is none), and the free windows' hashes of both."""

    def windows(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sides = []
        for values, free in ((a, free_a), (b, free_b)):
            taken = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(taken[length:] == taken[: len(taken) - length]) if len(values) >= length else np.empty(0, np.int64)
            sides += [at, vec.window_hashes(values, length)[at]]
        return tuple(sides)

    best, found = 0, None
    while least <= most:
        middle = (least + most) // 2 if best else least
        at_a, hash_a, at_b, hash_b = windows(middle)
        common = np.intersect1d(hash_a, hash_b)
        if len(common):
            best, least = middle, middle + 1
            keep_a, keep_b = np.isin(hash_a, common), np.isin(hash_b, common)
            found = (at_a[keep_a], hash_a[keep_a], at_b[keep_b], hash_b[keep_b])
        else:
            most = middle - 1
            if not best:
                break
    return best, found


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[int, int]:
    """Tokens of ``item`` covered by greedy tiles of ``doc``, and the number of tiles.

    Among equal lengths the leftmost in the item, then the leftmost in the document, is marked first.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    covered = tiles = 0
    most = min(len(item), len(doc))
    while most >= least:
        length, found = _longest(item, doc, free_item, free_doc, least, most)
        if not length:
            break
        at_item, hash_item, at_doc, hash_doc = found
        places: dict[int, list[int]] = {}
        for h, j in zip(hash_doc.tolist(), at_doc.tolist(), strict=True):
            places.setdefault(h, []).append(j)
        for h, i in zip(hash_item.tolist(), at_item.tolist(), strict=True):
            if not free_item[i : i + length].all():
                continue
            for j in places[h]:
                if free_doc[j : j + length].all():
                    free_item[i : i + length] = free_doc[j : j + length] = False
                    covered, tiles = covered + length, tiles + 1
                    break
        most = length - 1
    return covered, tiles


def coverable(seeds: np.ndarray, doc: np.ndarray, length: int) -> int:
    """Tokens of an item that lie in one of its ``seeds`` (of all its places, in order) which the document has as well."""
    at = np.flatnonzero(np.isin(seeds, vec.window_hashes(doc, length)))
    return _positions(at, len(seeds), length)


def _positions(at: np.ndarray, places: int, length: int) -> int:
    """How many tokens windows that begin ``at`` cover."""
    change = np.zeros(places + length + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return int((np.cumsum(change) > 0).sum())


def rarest(seeds: np.ndarray, documents: np.ndarray, tokens: int, coverage: float, length: int) -> np.ndarray:
    """Seeds without those most ``documents`` have, as many as cover less than ``coverage`` of an item's ``tokens`` between them.

    Whatever covers that share has one of the seeds that are left.
    """
    kinds, first, number = np.unique(seeds, return_index=True, return_inverse=True)
    places = np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1]) if len(kinds) else []
    order = np.lexsort((kinds, -documents[first]))
    covered, taken = 0, np.zeros(len(seeds) + length, bool)
    for k, kind in enumerate(order):
        for at in places[kind]:
            window = taken[at : at + length]
            covered += length - int(window.sum())
            window[:] = True
        if covered >= coverage * tokens:
            return kinds[order[k:]]
    return kinds[:0]


def candidates(items: DataFrame, met: DataFrame, coverage: float, seed: int) -> DataFrame:
    """Pairs (doc, row) of documents and rows of ``items`` that share one of the item's rarest seeds; written."""
    held = met.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("documents"))
    held = materialize(held, "seeds")
    placed = items.select("row", F.size("tokens").alias("n"), F.posexplode("seeds").alias("at", "seed")).join(held, "seed", "left")
    place = F.struct("at", "seed", F.coalesce("documents", F.lit(0)).alias("documents"))
    # as long as the item
    whole = placed.groupBy("row", "n").agg(F.sort_array(F.collect_list(place)).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = []
            for n, seeds, documents in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                picked.append(rarest(seeds.values.to_numpy(), documents.values.to_numpy(), n.as_py(), coverage, seed))
            sizes = np.array([len(p) for p in picked], np.int64)
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([rows, pa.array(np.concatenate([np.empty(0, np.int64), *picked]))], names=["row", "seed"])

    asked = whole.select("row", "n", F.col("p.seed").alias("seeds"), F.col("p.documents").alias("documents")).mapInArrow(run, "row bigint, seed bigint")
    asked = materialize(asked, "rarest")
    shared = met.select("doc", F.explode("seeds").alias("seed")).join(asked, "seed")
    return materialize(shared.select("doc", "row").distinct(), "pairs")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
    seed: int = SEED,
) -> DataFrame:
    """Rows (doc_id, item_id, item_tokens, covered_tokens, tiles, coverage) of documents that hold a benchmark item.

    A pair is returned if tiles of at least ``seed`` tokens of the document cover at least the share ``coverage`` of the item's
    tokens. Items of fewer than ``seed`` tokens, nulls and empty texts are in no pair; nor are rows with a null identifier.
    Rows sharing an identifier each give their pairs, and equal results are returned once.
    """
    items = benchmark_seeds(benchmark.where(F.col(item_id).isNotNull()), item_id, item_text, seed)
    met = _met_seeds(docs, doc_id, text, _bit_table(items), seed)
    pairs = candidates(items, met, coverage, seed)
    ready = pairs.join(met.select("doc", F.col("tokens").alias("doc_tokens")), "doc").join(items.select("row", "item", "tokens", "seeds"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, seeds, doc in zip(*(batch.column(k) for k in (2, 3, 4)), strict=True):
                item, seeds, doc = (side.values.to_numpy().view(np.uint64) for side in (item, seeds, doc))
                enough = coverable(seeds, doc, seed) >= coverage * len(item)
                found.append(tile(item, doc, seed) if enough else (0, 0))
            sizes = pc.list_value_length(batch.column(2)).cast(pa.int64())
            covered, tiles = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, covered, tiles], names=["doc", "item", "item_tokens", "covered_tokens", "tiles"])

    kinds = f"doc {ready.schema['doc'].dataType.simpleString()}, item {ready.schema['item'].dataType.simpleString()}"
    tiled = ready.select("doc", "item", "tokens", "seeds", "doc_tokens").mapInArrow(run, f"{kinds}, item_tokens bigint, covered_tokens bigint, tiles bigint")
    share = F.col("covered_tokens") / F.col("item_tokens")
    out = tiled.withColumn("coverage", share).where(share >= coverage).distinct()
    return out.withColumnsRenamed({"doc": doc_id, "item": item_id})


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows with a null identifier stay."""
    found = contaminated(docs, benchmark, doc_id=doc_id, **how).select(doc_id).distinct()
    return docs.join(found, doc_id, "left_anti")
