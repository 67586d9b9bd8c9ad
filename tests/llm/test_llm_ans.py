from __future__ import annotations

import zlib

import awkward
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hashgrove.llm import ans
from hashgrove.session import fresh_path

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
def test_blocks_round_trip_from_every_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000)
    used, counts = np.unique(ids, return_counts=True)
    model = ans.table(used, ans.scaled(counts).astype(np.uint64))
    words, places, states = ans.encode_block(ids, model)
    for k in range(max(1, len(places))):
        if n:
            found = ans.decode_block(words, places, states, n, model, k)
            assert (found == ids[k * ans.CHECKPOINT * ans.LANES :]).all()
    if n == 70_000:
        entropy = -(counts / n * np.log2(counts / n)).sum()
        assert len(words) * 32 / n < entropy * 1.02 + 0.1


def test_scaled_frequencies():
    counts = np.array([1, 1, 10**9, 5])
    assert ans.scaled(counts).sum() == 1 << ans.SCALE and ans.scaled(counts).min() == 1
    assert len(ans.scaled(np.array([], int))) == 0


def expected(rows):
    library = Tokenizer.from_file(FILE)
    out, start = [], 0
    encoded = [(doc, [*library.encode(text or "", add_special_tokens=False).ids, 2]) for doc, text in rows]
    for doc, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


def test_dataset_of_awkward_rows(spark):
    special = [(30, "A <|endoftext|> b"), (31, "it's o'clock, İstanbul ΣΑΣ. ≠ é'S x.́y don't!!"), (32, "<|startoftext|>")]
    rows = [(r[0], r[1]) for r in awkward.rows()] + special
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumn("n", F.lit(1)).withColumn("part", F.lit("p"))
    folder = fresh_path(spark, "ans-test")
    ans.write(docs, folder, FILE, end_id=2, block_ids=500)
    found = ans.read(spark, folder).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found] == expected(rows)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in found)
    assert spark.read.parquet(f"{folder}/blocks").count() > 3


def test_a_repeated_identifier_fills_several_parts(spark):
    folder = fresh_path(spark, "ans-test")
    rows = [(7, f"word {i % 3} again") for i in range(600)] + [(1, "first"), (9, "last")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ans.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), folder, FILE, end_id=2, block_ids=50)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = ans.read(spark, folder).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found] == expected(rows)
    assert spark.read.parquet(f"{folder}/blocks").select("part").distinct().count() > 1


def test_wrong_checksum_raises(spark):
    folder, other = fresh_path(spark, "ans-test"), fresh_path(spark, "ans-test")
    ans.write(awkward.frame(spark), folder, FILE, end_id=2)
    for name in ("frequencies", "parts"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{other}/{name}")
    spark.read.parquet(f"{folder}/blocks").withColumn("crc32", F.col("crc32") + 1).write.parquet(f"{other}/blocks")
    with pytest.raises(Exception, match="checksum"):
        ans.read(spark, other).collect()


def test_empty_table(spark):
    folder = fresh_path(spark, "ans-test")
    ans.write(awkward.empty(spark), folder, FILE, end_id=2)
    assert ans.read(spark, folder).count() == 0
