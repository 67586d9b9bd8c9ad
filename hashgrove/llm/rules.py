"""Quality rules, line first: bad lines go, then documents that lose too much. Built-in functions only.

Every line is judged by itself: is it a fragment that does not end like a sentence, is it a row of navigation, a boilerplate notice, symbols,
or shouting? Lines that fail are removed. A document is rejected if too large a share of its words went with them, or if
it fails the base rules (too short, or mostly repeated three-word windows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.repeats import let, window_hashes

SPACES = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
NAVIGATION = r"[|»›•·→]"
ENDINGS = r"[.!?:;…。！？][\"'”’»)\]]*\s*$"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|copyright \S*\s?\d{4}|licensed under|terms (?:of|and) (?:use|service|conditions)|privacy policy"
    r"|cookie (?:policy|settings)|uses? cookies|javascript|lorem ipsum|click here|read more|sign (?:in|up)|log ?in|subscribe)\b"
)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; shares are of a line's words, or of its characters in words."""

    window: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50
    navigation_per_word: float = 0.2
    symbols_per_char: float = 0.1
    capitals_per_char: float = 0.6
    shout_chars: int = 12
    fragment_words: int = 12
    max_lost: float = 0.5


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(found: Column, window: int) -> Column:
    """How many words of an array stand in a window that occurs at least twice, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        def mates(ordered: Column) -> Column:
            def same(entry: Column, i: Column) -> Column:
                near = [F.get(ordered, i + step)["hash"] == entry["hash"] for step in (-1, 1)]
                return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

            return F.sort_array(F.transform(F.filter(ordered, same), lambda entry: entry["at"]))

        entries = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        places = let(let(entries, mates), lambda at: F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))))
        total = F.aggregate(places, F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    hashes = F.coalesce(window_hashes(found, window), F.array().cast("array<bigint>"))
    return let(hashes, covered).cast("long")


def failing(line: Column, limits: Limits) -> Column:
    """Name of the first rule that a line fails, null if it is good."""

    def judged(size: Column) -> Column:
        return (
            F.when(F.regexp_count(line, F.lit(NAVIGATION)) >= size["n"] * limits.navigation_per_word, "navigation")
            .when(F.regexp_count(line, F.lit(SYMBOLS)) > size["chars"] * limits.symbols_per_char, "symbols")
            .when((size["chars"] >= limits.shout_chars) & (F.regexp_count(line, F.lit(r"\p{Lu}")) > size["chars"] * limits.capitals_per_char), "shouting")
            .when((size["n"] < limits.fragment_words) & ~line.rlike(ENDINGS), "punctuation")
            .when(line.rlike(BOILERPLATE), "boilerplate")
        )

    bare = F.regexp_count(line, F.lit(SPACES))
    return let(F.struct((bare + 1).alias("n"), (F.length(line) - bare).alias("chars")), judged)


def apply_rules(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with a struct column ``quality`` of measures, verdicts and the cleaned text.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, removed (lines removed, by
    their rule), clean_text, kept. A null text has no words, an empty clean text and is not kept. A clashing column
    ``quality`` of ``docs`` is replaced. Windows are told apart by 64-bit hashes within one document.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))

    def measured(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.aggregate(found, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            repeated_words(found, limits.window).alias("n_repeat_words"),
        )

    def cleaned(found: Column) -> Column:
        def report(judged: Column) -> Column:
            bad = F.filter(judged, lambda j: j["rule"].isNotNull())
            good = F.filter(judged, lambda j: j["rule"].isNull())
            return F.struct(
                F.aggregate(bad, F.lit(0).cast("long"), lambda n, j: n + j["n"]).alias("lost_words"),
                F.transform(bad, lambda j: j["rule"]).alias("removed"),
                F.array_join(F.transform(good, lambda j: j["line"]), "\n").alias("clean_text"),
                (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            )

        def judge(line: Column) -> Column:
            # inner white space counts words once the ends are trimmed
            trimmed = F.regexp_replace(line, r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$", "")
            return let(trimmed, lambda t: F.struct(line.alias("line"), failing(t, limits).alias("rule"), (F.regexp_count(t, F.lit(SPACES)) + 1).alias("n")))

        return let(F.transform(found, judge), report)

    staged = docs.withColumn(
        "quality",
        F.struct(let(words(whole), measured).alias("m"), let(lines, cleaned).alias("c"), F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols")),
    )
    m, c = F.col("quality.m"), F.col("quality.c")
    base_failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat_percent * m["n_words"])
    return staged.withColumn(
        "quality",
        F.struct(
            m["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            F.col("quality.n_symbols").alias("n_symbols"),
            c["n_dup_lines"].alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            base_failed.alias("base_failed"),
            c["lost_words"].alias("lost_words"),
            c["removed"].alias("removed"),
            c["clean_text"].alias("clean_text"),
            (~base_failed & (c["lost_words"] <= m["n_words"] * limits.max_lost)).alias("kept"),
        ),
    )
