"""Rows that every operator must take: nulls, blanks, long texts, ties, repeats and columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, id bigint, hash string, at int, y int, score double, component bigint, quality string, covered int"


def sentence(rng: random.Random, n: int = 9) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


WORDS = "river stone garden winter letter bridge silver candle forest market window summer engine harbor meadow travel copper island".split()


def texts(seed: int = 1, n: int = 12) -> list[str]:
    rng = random.Random(seed)
    return ["\n".join(" ".join(sentence(rng) for _ in range(3)) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def long_text(n: int = 30_000) -> str:
    rng = random.Random(9)
    return "\n".join(sentence(rng, 12) for _ in range(n // 12))


def rows() -> list[tuple]:
    some = texts()
    plain = [(i, t) for i, t in enumerate(some)]
    odd = [(None, some[0]), (None, None), (20, None), (21, ""), (22, " \n\t "), (23, some[1]), (23, some[1]), (24, long_text()), (25, "é漢😀 x́"), (26, "a" * 5000)]
    return [(*row, 7, "x", 1, 1, 0.5, 3, "q", 0) for row in plain + odd]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
