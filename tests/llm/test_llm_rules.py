from __future__ import annotations

import re

import awkward
import pytest

from hashgrove.llm import rules

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    base = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), base


CASES = ["a b c a b c", "a a a a a", "x y z\nx y z\n\n \nx y z", "one two", "# * | <b> & %", "a b c d a b c", "w " * 70, "p q r s t\x0bu\x85v  w", None, ""]


def test_measures_are_those_of_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100 + k, r[1]) for k, r in enumerate(awkward.rows()) if r[0] != 24]
    found = rules.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "quality.*").collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    texts = dict(rows)
    for r in found:
        assert tuple(r[f] for f in fields) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("A plain sentence, with an end.", None),
        ('He said "so it is."', None),
        ("home | products | about | contact | help", "navigation"),
        ("word&&& other*** third$$$ here%%%", "symbols"),
        ("BUY NOW!! CHEAP!! ONLY TODAY!!", "shouting"),
        ("no end to this line", "punctuation"),
        ("Copyright (c) 2024 Somebody. All rights reserved.", "boilerplate"),
        ("This site uses cookies.", "boilerplate"),
    ],
)
def test_lines_fail_by_their_rule(spark, line, rule):
    good = awkward.long_text(120)
    row = rules.apply_rules(spark.createDataFrame([(1, good + "\n" + line)], "doc_id bigint, text string")).first()
    assert row["quality"]["removed"] == ([rule] if rule else [])
    assert (line in row["quality"]["clean_text"]) == (rule is None) and row["quality"]["kept"]


def test_documents_that_lose_too_much_go(spark):
    good = awkward.long_text(60)
    bad = [" | ".join(f"item{20 * i + k}" for k in range(20)) for i in range(12)]
    docs = [(1, "\n".join([good, bad[0]])), (2, "\n".join([good, *bad]))]
    found = {r["doc_id"]: r["quality"] for r in rules.apply_rules(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[1]["kept"] and not found[2]["kept"] and not found[2]["base_failed"]


def test_awkward_rows_and_no_python(spark):
    docs = awkward.frame(spark)
    out = rules.apply_rules(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    found = {r["doc_id"]: r["quality"] for r in out.collect()}
    assert found[20]["n_words"] == 0 and not found[20]["kept"] and found[20]["clean_text"] == ""
    assert found[24]["n_words"] == len(awkward.long_text().split())
    assert rules.apply_rules(awkward.empty(spark)).count() == 0
