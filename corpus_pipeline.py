"""A cleaning pipeline over ``documents``: every stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.llm import bpe, decontam, lines, simhash, toxicity
from hashgrove.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.7
SHINGLE, BITS = 3, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score less than ``TOXIC``; labels of the held-out third are not learned from. Null identifiers stay."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rejected = toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("score") >= TOXIC).select("doc_id").distinct()
    return docs.join(materialize(rejected, "toxic"), "doc_id", "left_anti").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the later copies of three-line windows; one that consists of them goes."""
    return lines.dedupe_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each component of fingerprints of ``SHINGLE``-word shingles that differ in at most ``BITS`` bits."""
    return simhash.keep_first(docs, shingle=SHINGLE, distance=BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of what is left, and the digest of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, ranks).withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(encoded, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: Language-model scores, pre-tokenisation and merges cannot be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
