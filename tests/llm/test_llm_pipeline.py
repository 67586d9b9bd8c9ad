"""The pipeline against the same steps one document at a time, and its stages on rows that are hard to take."""

from __future__ import annotations

import base64
import hashlib
import re

import awkward
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_llm_decontam import brute_tiles, tokens
from test_llm_repeats import CASES, brute
from test_llm_simhash import classes, fingerprint

import corpus_pipeline as pipeline
from hashgrove.llm import toxicity
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def by_brute_force(spark, rows, benchmark, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # language-model scores are the operator's own, tested apart; what follows from them is not
    model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    left = {i: t for i, t in rows if scores[i] < 0.7}
    cut = brute(sorted(left.items()), *CASES["lines"][1:])
    left = {i: t for i, t in cut.items() if t.strip() or not left[i].strip()}
    prints = {i: fingerprint(t) for i, t in left.items()}
    groups = {}
    for i, f in prints.items():
        groups.setdefault(f, []).append(i)
    least = classes(groups, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for f, name in least.items():
        first[name] = min([first.get(name, min(groups[f])), *groups[f]])
    left = {i: t for i, t in left.items() if first[least[prints[i]]] == i}
    items = [w for w in map(tokens, benchmark) if len(w) >= 5]
    # a pair of few common words cannot be covered
    small = [(w, set(w)) for w in items]

    def holds(text):
        words = tokens(text)
        own = set(words)
        for item, kinds in small:
            if sum(w in own for w in item) >= 0.5 * len(item) and {tuple(item[k : k + 5]) for k in range(len(item) - 4)} & {tuple(words[k : k + 5]) for k in range(len(words) - 4)}:
                if brute_tiles(item, words, 5)[0] >= 0.5 * len(item):
                    return True
        return False

    left = {i: t for i, t in left.items() if not holds(t)}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = set()
    for i, text in left.items():
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        out.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    benchmark = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = {tuple(r) for r in pipeline.run(spark, FOLDER).collect()}
    assert found == by_brute_force(spark, rows, benchmark, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert 0 < len(found) < len(rows)


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_take_awkward_rows(spark, name):
    stage = dict(pipeline.STAGES)[name]
    docs = awkward.frame(spark)
    out = stage(spark, docs, FOLDER)
    found = [r["doc_id"] for r in out.collect()]
    if name != pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    # clean documents stay in every stage, the nameless ones too
    assert set(range(12)) <= set(found) and found.count(None) == 2
    assert stage(spark, awkward.empty(spark), FOLDER).count() == 0


def test_stages_are_registered():
    import __spark_entry__

    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= {re.match(r"op\d+|\w+", q)[0] for q in __spark_entry__.queries()}
