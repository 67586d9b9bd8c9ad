"""Frequencies by count-min sketches that merge by sums, with heavy hitters.

A sketch of a key's category is a matrix of ``depth`` rows and ``width`` columns: each row has a random hash, and a value adds to one
column of every row. An estimate is the least of its columns: never below the true count, and above it by more than ``eps`` of
the total with a chance of ``delta`` at most. The matrix is kept as rows (key, category, depth, bucket, n), so that sketches of
parts, cells or days are merged by one aggregate. Candidates for heavy hitters come from the same pass: each task keeps the values that
may make up more than ``eps`` of what it has read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.session import materialize

# Parameters of the reference sketch.
SEED, EPS, DELTA, HITTERS = 1, 0.001, 1e-10, 50
CANDIDATE = -1  # depth of a row that names a candidate
HELD = 48  # matrices held by a task


@dataclass(frozen=True)
class Shape:
    """Size of a sketch: ``width`` columns for the error ``eps``, ``depth`` rows for the chance ``delta``."""

    eps: float = EPS
    delta: float = DELTA
    seed: int = SEED

    @property
    def width(self) -> int:
        return math.ceil(math.e / self.eps)

    @property
    def depth(self) -> int:
        return math.ceil(math.log(1 / self.delta))

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        """Columns of values by their 64-bit hashes: one row of the result for each row of the matrix."""
        row = np.arange(1, self.depth + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed)
        mixed = hashes.astype(np.int64).view(np.uint64)[None, :] ^ row
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(times)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(self.width)).astype(np.int64)


@dataclass(frozen=True)
class Sketch:
    """Merged rows: ``cells`` (keys, category, depth, bucket, n), ``candidates`` (keys, category, value)."""

    keys: tuple[str, ...]
    shape: Shape
    cells: DataFrame
    candidates: DataFrame


class _Task:
    """Matrices and candidates of one task, by key and category."""

    def __init__(self, shape: Shape, names: Sequence[str]):
        self.shape, self.names = shape, names
        self.most = 2 * math.ceil(1 / shape.eps)
        self.matrices: dict[tuple, np.ndarray] = {}
        self.seen: dict[tuple, dict[str, int]] = {}

    def add(self, key: tuple, category: int, values: list[str], hashes: np.ndarray, counts: np.ndarray) -> None:
        place = (*key, category)
        if place not in self.matrices:
            self.matrices[place] = np.zeros((self.shape.depth, self.shape.width), np.int64)
            self.seen[place] = {}
        matrix, seen = self.matrices[place], self.seen[place]
        for row, buckets in zip(matrix, self.shape.buckets(hashes), strict=True):
            np.add.at(row, buckets, counts)
        for value, n in zip(values, counts.tolist(), strict=True):
            seen[value] = seen.get(value, 0) + n
        if len(seen) > self.most:
            # a value above 1 / most of what was read outlives this: everybody pays the same
            price = sorted(seen.values(), reverse=True)[self.most // 2]
            self.seen[place] = {value: n - price for value, n in seen.items() if n > price}

    def rows(self, kinds: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for place, matrix in self.matrices.items():
            depth, bucket = np.nonzero(matrix)
            yield self._batch(place, kinds, depth, bucket, None, matrix[depth, bucket])
            seen = self.seen[place]
            none = np.full(len(seen), CANDIDATE)
            yield self._batch(place, kinds, none, none, list(seen), np.fromiter(seen.values(), np.int64, len(seen)))
        self.matrices, self.seen = {}, {}

    def _batch(self, place: tuple, kinds: Sequence[pa.DataType], depth: np.ndarray, bucket: np.ndarray, values: list[str] | None, n: np.ndarray) -> pa.RecordBatch:
        keys = [pa.array([k] * len(n), kind) for k, kind in zip(place[:-1], kinds, strict=True)]
        columns = [pa.array([self.names[place[-1]]] * len(n), pa.string()), pa.array(depth.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(values or [None] * len(n), pa.string()), pa.array(n)]
        return pa.RecordBatch.from_arrays([*keys, *columns], names=[*[f"k{i}" for i in range(len(keys))], "category", "depth", "bucket", "value", "n"])


def summarise(df: DataFrame, keys: Mapping[str, Column], categories: Mapping[str, Column], shape: Shape = Shape()) -> Sketch:
    """Sketches of every category for every key, in one pass over ``df``; null values are absent, a null key is a key.

    A task holds ``HELD`` matrices at most and sends what it has when there are more; its rows are bounded by the size of the
    matrices, whatever it reads. The summary of all tasks is written once.
    """
    names, n_keys = list(categories), len(keys)
    columns = [c.alias(f"k{i}") for i, c in enumerate(keys.values())]
    for i, value in enumerate(categories.values()):
        text = value.cast("string")
        columns += [text.alias(f"v{i}"), F.xxhash64(text).alias(f"h{i}")]
    rows = df.select(*columns)
    kinds = {f"k{i}": rows.schema[f"k{i}"].dataType.simpleString() for i in range(n_keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, types = _Task(shape, names), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            types = [batch.schema.field(k).type for k in range(n_keys)]
            by = [f"k{i}" for i in range(n_keys)]
            for i in range(len(names)):
                counted = table.filter(table.column(f"v{i}").is_valid()).group_by([*by, f"v{i}", f"h{i}"]).aggregate([([], "count_all")])
                if by:
                    counted = counted.sort_by([(k, "ascending") for k in by])
                held = [counted.column(k).to_pylist() for k in by]
                values, hashes = counted.column(f"v{i}").to_pylist(), counted.column(f"h{i}").to_numpy()
                counts = counted.column("count_all").to_numpy()
                first = 0
                for at in range(1, len(values) + 1):
                    if at == len(values) or any(h[at] != h[first] for h in held):
                        task.add(tuple(h[first] for h in held), i, values[first:at], hashes[first:at], counts[first:at])
                        first = at
                    if len(task.matrices) >= HELD:
                        yield from task.rows(types)
        if types:
            yield from task.rows(types)

    schema = ", ".join([*[f"{k} {t}" for k, t in kinds.items()], "category string, depth int, bucket int, value string, n bigint"])
    found = rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(kinds, keys)))
    return merged(materialize(found, "sketch"), tuple(keys), shape)


def merged(rows: DataFrame, keys: tuple[str, ...], shape: Shape) -> Sketch:
    """The sketch of summary rows, of however many tasks, parts or days."""
    cells = rows.where(F.col("depth") != CANDIDATE).groupBy(*keys, "category", "depth", "bucket").agg(F.sum("n").alias("n"))
    return Sketch(keys, shape, cells, rows.where(F.col("depth") == CANDIDATE).select(*keys, "category", "value").distinct())


def regrouped(sketch: Sketch, regroup, keys: tuple[str, ...]) -> Sketch:
    """The sketch for other keys: ``regroup`` copies rows to them, cells of one key are added up."""
    cells = regroup(sketch.cells).groupBy(*keys, "category", "depth", "bucket").agg(F.sum("n").alias("n"))
    return Sketch(keys, sketch.shape, cells, regroup(sketch.candidates).select(*keys, "category", "value").distinct())


def totals(sketch: Sketch) -> DataFrame:
    """Rows (keys, category, total): how many values each matrix has counted."""
    return sketch.cells.where("depth = 0").groupBy(*sketch.keys, "category").agg(F.sum("n").alias("total"))


def estimates(sketch: Sketch, asked: DataFrame) -> DataFrame:
    """``asked`` rows (keys, category, value), each once, with their estimated count ``n``; 0 where the sketch has nothing of it."""
    keys, shape = sketch.keys, sketch.shape
    columns = [*keys, "category", "value"]
    rows = materialize(asked.select(*columns).withColumn("_id", F.monotonically_increasing_id()), "asked")
    wanted = rows.select("_id", F.xxhash64("value").alias("_hash"), *keys, "category")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = shape.buckets(batch.column(1).to_numpy())
            depth = np.repeat(np.arange(shape.depth, dtype=np.int32), batch.num_rows)
            again = batch.take(pa.array(np.tile(np.arange(batch.num_rows), shape.depth)))
            kept = [again.column(0), pa.array(depth), pa.array(buckets.ravel().astype(np.int32)), *again.columns[2:]]
            yield pa.RecordBatch.from_arrays(kept, names=["_id", "depth", "bucket", *batch.schema.names[2:]])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[2:]]
    placed = wanted.mapInArrow(place, ", ".join(["_id bigint, depth int, bucket int", *kinds]))
    cells = sketch.cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("category").alias("_category"), F.col("depth").alias("_depth"), F.col("bucket").alias("_bucket"), "n")
    same = (F.col("depth") == F.col("_depth")) & (F.col("bucket") == F.col("_bucket")) & (F.col("category") == F.col("_category"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    least = placed.join(cells, same, "left").groupBy("_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    # what is asked may be as many rows as the input: its written size would pass for one to broadcast
    return rows.hint("merge").join(least, "_id").select(*columns, "n")


def heavy_hitters(sketch: Sketch, top: int = HITTERS) -> DataFrame:
    """Rows (keys, category, value, n): for each key and category the ``top`` candidates by estimate, ties by value.

    Every value that makes up more than ``eps`` of its category is a candidate.
    """
    found = estimates(sketch, sketch.candidates)
    place = F.row_number().over(Window.partitionBy(*sketch.keys, "category").orderBy(F.desc("n"), F.asc("value")))
    return found.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
