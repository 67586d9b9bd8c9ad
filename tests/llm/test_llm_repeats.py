from __future__ import annotations

import random
import re

import awkward
import pytest

from hashgrove.llm import lines, sentences

SPACES = " \t\n\r\x0b\x0c"


def run_of(full, at, least, words):
    """The shortest run from ``at`` on of enough units and words, None if there is none."""
    for n in range(least, len(full) - at + 1):
        if sum(len(key.split()) for _, key in full[at : at + n]) >= words:
            return full[at : at + n]
    return None


def brute(rows, cut, glue, least, words):
    """Texts after the later copies of windows are removed, one document and window at a time."""
    units = {i: [(p, p.strip(SPACES)) for p in cut(t or "")] for i, t in rows if i is not None}
    seen, gone = set(), {i: set() for i in units}
    for i in sorted(units):
        full = [(n, key) for n, (_, key) in enumerate(units[i]) if key]
        for at in range(len(full)):
            run = run_of(full, at, least, words) if words else full[at : at + least]
            if run is None or len(run) < least:
                continue
            window = tuple(key for _, key in run)
            if window in seen:
                gone[i].update(n for n, _ in run)
            seen.add(window)
    return {i: glue.join(p for n, (p, _) in enumerate(units[i]) if n not in gone[i]) if gone[i] else dict(rows)[i] for i in units}


def sentences_of(text):
    whole = re.split(r"(?:(?<=[.!?][ \t\r\n])|(?<=\n))(?=[^ \t\r\n])", text)
    return [part for s in whole for part in (re.split("(?<=[,;:nt] )", s) if len(s.split()) > 24 else [s])]


CASES = {
    "lines": (lines.dedupe_lines, lambda t: t.split("\n"), "\n", 3, 0),
    "sentences": (sentences.dedupe_spans, sentences_of, "", 2, 12),
}


@pytest.mark.parametrize("case", CASES)
def test_later_copies_go(spark, case):
    operator, *how = CASES[case]
    rng = random.Random(3)
    pool = [awkward.sentence(rng, 4) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", " " + rng.choice(pool)]) + rng.choice(["", "\n", "  "]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: r["text"] for r in operator(docs).collect()}
    assert found == brute(rows, *how)


@pytest.mark.parametrize("case", CASES)
def test_awkward_rows(spark, case):
    operator, *how = CASES[case]
    docs = awkward.frame(spark)
    out = operator(docs)
    assert out.columns == docs.columns
    found = sorted((repr(r["doc_id"]), repr(r["text"])) for r in out.collect())
    rows = awkward.rows()
    expected = brute([(r[0], r[1]) for r in rows], *how)
    # rows sharing an identifier are one document: the second copy of 23 is not a later copy of the first
    wanted = [(r[0], r[1] if r[0] is None else expected[r[0]]) for r in rows]
    assert found == sorted((repr(i), repr(t)) for i, t in wanted)


@pytest.mark.parametrize("case", CASES)
def test_repeated_unit_shrinks_to_one_copy_and_counts(spark, case):
    operator, *_ = CASES[case]
    docs = spark.createDataFrame([(1, "\n".join(["Same line of seven words in all."] * 9))], "doc_id bigint, text string")
    row = operator(docs, counts=("n", "gone")).first()
    assert (row["text"].strip(), row["n"], row["gone"]) == ("Same line of seven words in all.", 9, 8)


def test_whole_copies_can_be_dropped(spark):
    text = "\n".join(awkward.texts(n=4)).replace("\n\n", "\n")
    docs = [(1, text), (2, text), (3, ""), (4, None), (5, text + "\nOne more line."), (6, "Short.")]
    found = {r["doc_id"]: r["text"] for r in lines.dedupe_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), drop_emptied=True).collect()}
    assert found == {1: text, 3: "", 4: None, 5: "One more line.", 6: "Short."}


@pytest.mark.parametrize("case", CASES)
def test_empty_table(spark, case):
    assert CASES[case][0](awkward.empty(spark)).count() == 0


def test_a_passage_inside_other_text_goes(spark):
    rng = random.Random(5)
    passage = " ".join(awkward.sentence(rng, 12) for _ in range(6))
    docs = [(1, f"Own start here. {passage} Own end."), (2, f"Another one begins.\n{passage}\nAnd it ends."), (3, "Clean text. Nothing else.")]
    found = {r["doc_id"]: r["text"] for r in sentences.dedupe_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[1] == docs[0][1] and found[3] == docs[2][1]
    assert found[2] == "Another one begins.\nAnd it ends."


def test_a_passage_without_marks_goes(spark):
    rng = random.Random(7)
    passage = " ".join(rng.choice(awkward.WORDS) for _ in range(55))
    docs = [(1, f"own words before {passage} and after"), (2, f"other beginnings {passage} other end")]
    found = {r["doc_id"]: r["text"] for r in sentences.dedupe_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[1] == docs[0][1] and len(found[2].split()) < 25 and found[2].startswith("other beginnings") and found[2].endswith("other end")
