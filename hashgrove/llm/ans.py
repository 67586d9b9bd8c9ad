"""Token ids in binary files, entropy-coded by a static range asymmetric numeral system (rANS).

A dataset is a folder with three Parquet tables, so that any store Spark can write holds it:

* ``frequencies``: the shared table, one row for each id that occurs, scaled to a total of 2**SCALE;
* ``blocks``: runs of whole documents in ascending order. A block is coded by itself in ``LANES`` interleaved lanes with
  64-bit states and 32-bit words, and has its first id's place, the document lengths, a CRC-32 of its ids and its checkpoints;
* ``parts``: how many ids come before each part.

Blocks are decoded independently, and each from any of its checkpoints: the lanes' states and the place in the words every
``CHECKPOINT`` steps. A wrong checksum raises.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashgrove.llm import vec
from hashgrove.session import fresh_path, materialize

SCALE = 20
LANES = 256
BLOCK_IDS = 1 << 17
HEAD = 64  # bytes of its ids that a document is ordered by, after its identifier
CHECKPOINT = 128
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
KNOWN = 1 << 20


@dataclass(frozen=True)
class Table:
    """Scaled frequencies of ids 0 .. n - 1, where each begins, and the id of every slot."""

    frequency: np.ndarray
    begin: np.ndarray
    slots: np.ndarray


def table(ids: np.ndarray, frequency: np.ndarray) -> Table:
    size = int(ids.max()) + 1 if len(ids) else 1
    full = np.zeros(size, np.uint64)
    full[ids] = frequency
    begin = np.cumsum(full) - full
    return Table(full, begin, np.repeat(np.arange(size, dtype=np.uint32), full.astype(np.int64)))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of 2**SCALE, at least one each; what rounding leaves over is dealt by size, ties by place."""
    if not len(counts):
        return counts
    total = 1 << SCALE
    if len(counts) > total:
        raise ValueError(f"{len(counts)} different ids do not fit a table of {total}")
    exact = counts.astype(np.float64) * ((total - len(counts)) / counts.sum())
    out = 1 + np.floor(exact).astype(np.int64)
    order = np.lexsort((np.arange(len(counts)), np.floor(exact) - exact))
    out[order[: total - int(out.sum())]] += 1
    return out


def encode_block(ids: np.ndarray, model: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and at every checkpoint the place in the words and the lanes' states. Id number i is in lane i % LANES."""
    steps = -(-len(ids) // LANES)
    padded = np.full(steps * LANES, ids[0] if len(ids) else 0, np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(steps, LANES)
    state = np.full(LANES, LOW)
    words, used = np.empty((steps, LANES), np.uint32), np.empty((steps, LANES), bool)
    saved = np.empty((-(-steps // CHECKPOINT), LANES), np.uint64)
    for t in range(steps - 1, -1, -1):
        f = model.frequency[grid[t]]
        over = state >= f << np.uint64(63 - SCALE)
        words[t], used[t] = state.astype(np.uint32), over
        state = np.where(over, state >> WORD, state)
        quotient = state // f
        state = (quotient << np.uint64(SCALE)) + (state - quotient * f) + model.begin[grid[t]]
        if t % CHECKPOINT == 0:
            saved[t // CHECKPOINT] = state
    before = np.cumsum(used.sum(1)) - used.sum(1)
    return words[used], before[::CHECKPOINT].astype(np.uint64), saved


def decode_block(words: np.ndarray, places: np.ndarray, states: np.ndarray, n: int, model: Table, first: int = 0) -> np.ndarray:
    """Ids of a block from checkpoint ``first`` on; ``n`` is the number of all its ids."""
    steps = -(-n // LANES)
    start = first * CHECKPOINT
    grid = np.empty((max(0, steps - start), LANES), np.uint32)
    if not len(grid):
        return grid.ravel()
    state, at = states[first].copy(), int(places[first])
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(len(grid)):
        slot = state & mask
        ids = model.slots[slot]
        grid[t] = ids
        state = model.frequency[ids] * (state >> np.uint64(SCALE)) + slot - model.begin[ids]
        need = np.flatnonzero(state < LOW)
        state[need] = state[need] << WORD | words[at : at + len(need)].astype(np.uint64)
        at += len(need)
    return grid.ravel()[: n - start * LANES]


class Words:
    """Ids of white-space-separated words by a tokenizers file, with a bounded memory of the words met.

    The file's normaliser and pre-tokeniser see no further than a word's bounds, and ASCII punctuation other than an apostrophe
    after an ASCII letter always begins a piece. So a text is cut there as well, ASCII letters are lower-cased, and the library
    sees each different word once. Texts that spell one of its special tokens are encoded by it whole.
    """

    def __init__(self, path: str):
        # a task has a core of its own; threads of the library would wait for one another
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.special = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        self.forget()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.letter = np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.mark = np.zeros(256, bool)
        self.mark[[c for c in range(33, 127) if chr(c) not in "'" and not chr(c).isalnum()]] = True

    def forget(self) -> None:
        self.hashes, self.at, self.counts, self.ids = (np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.uint32))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and the first id of each (one more at the end)."""
        folded = self.lower[data]
        solid = ~vec.SPACE[data]
        starts, ends = vec.spans(solid, offsets)
        cuts = np.flatnonzero(self.letter[data[:-1]] & self.mark[data[1:]]) + 1 if len(data) > 1 else np.empty(0, np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        cuts = cuts[~edge[cuts]]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        hashes, first, inverse = np.unique(vec.span_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = where < len(self.hashes)
        known[inside] = self.hashes[where[inside]] == hashes[inside]
        if not known.all():
            if len(self.hashes) > KNOWN:
                self.forget()
                known[:] = False
            fresh = np.flatnonzero(~known)
            raw = folded.tobytes()
            found = self.library.encode_batch_fast([raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[fresh]], add_special_tokens=False)
            lists = [np.array(x.ids, np.uint32) for x in found]
            counts = np.array([len(x) for x in lists], np.int64)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts) - counts])
            self.ids = np.concatenate([self.ids, *lists])
            self.counts = np.concatenate([self.counts, counts])
            self.hashes = np.concatenate([self.hashes, hashes[fresh]])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.at, self.counts = self.hashes[order], self.at[order], self.counts[order]
            where = np.searchsorted(self.hashes, hashes)
        slot = where[inverse]
        counts = self.counts[slot]
        ids = self.ids[vec.ragged(self.at[slot], counts)]
        before = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        bounds = before[vec.owners(starts, offsets)]
        raw = folded.tobytes()
        if any(special in raw for special in self.special):
            whole, texts = [], data.tobytes()
            for k in range(len(offsets) - 1):
                own = ids[bounds[k] : bounds[k + 1]]
                if any(special in raw[offsets[k] : offsets[k + 1]] for special in self.special):
                    own = np.array(self.library.encode(texts[offsets[k] : offsets[k + 1]].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
                whole.append(own)
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
            ids = np.concatenate(whole)
        return ids, bounds


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc, ids, n) of all documents; ``ids`` are little-endian unsigned integers of two or four bytes, ``end_id`` last.

    The width is two bytes if the vocabulary allows. A null or empty text has only the end id.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words(tokenizer)
        width = "<u2" if max(model.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for first, last, data, offsets in vec.pieces(batch.column(1)):
                ids, bounds = model.encode(data, offsets)
                ids = np.insert(ids, bounds[1:], end_id).astype(width)
                bounds = bounds + np.arange(len(bounds))
                n = last - first
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), binary, pa.array(np.diff(bounds))], names=["doc", "ids", "n"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, ids binary, n bigint")


def _width(spans: np.ndarray, counts: np.ndarray) -> str:
    return "<u4" if int(spans.sum()) == 4 * int(counts.sum()) else "<u2"


def _counted(ids: DataFrame) -> DataFrame:
    """Rows (id, frequency): how often each id occurs in all documents, scaled. At most one row of the vocabulary each comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = vec.buffers(batch.column(0))
            found = np.bincount(np.frombuffer(data.tobytes(), _width(np.diff(offsets), batch.column(1).to_numpy()))).astype(np.int64)
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids", "n").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    scaled_rows = rows.assign(frequency=scaled(rows["n"].to_numpy()))[["id", "frequency"]]
    return ids.sparkSession.createDataFrame(scaled_rows, "id bigint, frequency bigint")


def _model(frequencies: DataFrame) -> Table:
    rows = frequencies.toPandas()
    return table(rows["id"].to_numpy(), rows["frequency"].to_numpy().astype(np.uint64))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id", block_ids: int = BLOCK_IDS) -> None:
    """Write the dataset of ``docs`` to ``folder``: ids in ascending order of documents, each document ended by ``end_id``.

    Documents are ordered by identifier, nulls first, equal ones by the first bytes of their ids, then by a hash of them all. A part is what
    one task has after a range partitioning in this order, which also tells equal rows apart, so a repeated identifier fills as many parts as it needs;
    only ids are exchanged. A block ends with the document that fills it (``block_ids``), so a longer document is a block of its own. An empty table
    gives a dataset without blocks. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ids = materialize(tokenize(docs, tokenizer, end_id, text, doc_id).withColumn("place", F.monotonically_increasing_id()), "ids")
    _counted(ids).coalesce(1).write.parquet(f"{folder}/frequencies")
    sent = spark.sparkContext.broadcast(_model(spark.read.parquet(f"{folder}/frequencies")))
    kind = ids.schema["doc"].dataType.simpleString()

    def block(part: int, number: int, docs_in: list, lengths: list[np.ndarray], pieces: list[np.ndarray], start: int) -> pa.RecordBatch:
        own = np.concatenate(pieces)
        coded, places, states = encode_block(own.astype(np.int64), sent.value)
        sizes = np.concatenate(lengths)
        columns = [
            pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(own)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(docs_in)),
            pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes)),
            pa.array([coded.tobytes()], pa.binary()), pa.array([places.tobytes() + states.tobytes()], pa.binary()),
            pa.array([zlib.crc32(own.astype("<u4").tobytes())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "block", "start", "n_ids", "docs", "lengths", "words", "checkpoints", "crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, start, held, docs_in, lengths, pieces = 0, 0, 0, [], [], []
        for batch in batches:
            data, offsets = vec.buffers(batch.column(1))
            counts = batch.column(2).to_numpy()
            flat = np.frombuffer(data.tobytes(), _width(np.diff(offsets), counts))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            at = 0
            while at < len(counts):
                # the documents that fill the block
                end = int(np.searchsorted(bounds, bounds[at] + block_ids - held, "left"))
                end = min(max(end, at + 1), len(counts))
                pieces.append(flat[bounds[at] : bounds[end]])
                lengths.append(counts[at:end])
                docs_in.append(batch.column(0).slice(at, end - at))
                held += int(bounds[end] - bounds[at])
                at = end
                if held >= block_ids:
                    yield block(part, number, docs_in, lengths, pieces, start)
                    number, start, held, docs_in, lengths, pieces = number + 1, start + held, 0, [], [], []
        if pieces:
            yield block(part, number, docs_in, lengths, pieces, start)

    order = ["doc", F.substring("ids", 1, HEAD), F.xxhash64("ids"), "place"]
    ordered = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "ids", "n")
    schema = f"part int, block int, start bigint, n_ids bigint, docs array<{kind}>, lengths array<bigint>, words binary, checkpoints binary, crc32 bigint"
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/blocks")
    parts = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.select("part", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str, doc_id: str = "doc_id", ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of a dataset, decoded block by block.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit integers.
    """
    sent = spark.sparkContext.broadcast(_model(spark.read.parquet(f"{folder}/frequencies")))
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row for each part
    blocks = blocks.join(F.broadcast(spark.read.parquet(f"{folder}/parts")), "part").withColumn("start", F.col("start") + F.col("before"))
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    names = [doc_id, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                docs, lengths = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy()
                start, n, crc = (batch.column(c)[k].as_py() for c in (2, 3, 4))
                coded = np.frombuffer(batch.column(5)[k].as_py(), np.uint32)
                points = np.frombuffer(batch.column(6)[k].as_py(), np.uint64)
                count = len(points) // (LANES + 1)
                found = decode_block(coded, points[:count], points[count:].reshape(count, LANES), n, model).astype("<u4")
                raw = found.tobytes()
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"the block of ids from {start} on does not have its checksum")
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [docs, pa.array(start + bounds[:-1]), pa.array(lengths), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(raw)]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{doc_id}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids
    return blocks.select("docs", "lengths", "start", "n_ids", "crc32", "words", "checkpoints").mapInArrow(run, schema)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return fresh_path(spark, "tokens")
