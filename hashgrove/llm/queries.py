"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashgrove.llm import ans, bpe, decontam, language, lines, pages, quality, resampling, rules, sentences, simhash, spelling, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE of every document, decoded again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_table(spark, folder, "documents"), ranks).withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = bpe.decode(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the later copies of three-line windows."""
    return lines.dedupe_lines(_table(spark, folder, "documents").select("doc_id", "text"), counts=("n_lines", "n_removed"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document; labels of the held-out third are not learned from."""
    docs = _table(spark, folder, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.fit(docs, _table(spark, folder, "labels").where(fold != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_duplicates(_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of the line-first rules for every document."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
    judged = rules.apply_rules(_table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"quality.{f}") for f in fields])


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; labels of the held-out fifth are not learned from."""
    docs = _table(spark, folder, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    network = quality.fit(docs, _table(spark, folder, "labels").where((fold != 0) & (F.col("quality") == 1)))
    scored = quality.score(docs, network)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the later copies of sentence spans."""
    return sentences.dedupe_spans(_table(spark, folder, "documents").select("doc_id", "text"), counts=("n_sentences", "n_removed"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written to rANS files and read back."""
    files = ans.fresh_folder(spark)
    ans.write(_table(spark, folder, "documents"), files, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return ans.read(spark, files, ids=False)


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its near words, its form and the root of its forms."""
    return spelling.spelling_variants(_table(spark, folder, "documents"))


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; the held-out fifth is not learned from."""
    docs = _table(spark, folder, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = language.identify(docs, language.fit(docs.where(fold != 0)))
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of every document for the benchmark's distribution, and a draw of five in a hundred."""
    return resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


_SPACES = "chr(9) || chr(13) || chr(11) || chr(12)"


def _repeat_sql(pieces: str, key: str, glue: str, names: tuple[str, str], windows: str) -> str:
    """Windows (doc_id, pos, n, h) of full pieces over all documents; later copies are cut."""
    return f"""
    WITH cut AS (SELECT doc_id, text, {pieces} AS pieces FROM documents),
    piece AS (SELECT doc_id, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS i FROM cut),
    keyed AS (SELECT doc_id, i, p, {key} AS k FROM piece),
    filled AS (SELECT doc_id, i, k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM keyed WHERE k <> ''),
    win AS ({windows}),
    late AS (SELECT doc_id, pos, n FROM (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS r FROM win) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, pos + unnest(range(n)) AS pos FROM late),
    marked AS (SELECT k.doc_id, k.i, k.p, f.pos, g.pos IS NOT NULL AS cut FROM keyed k
        LEFT JOIN filled f ON f.doc_id = k.doc_id AND f.i = k.i LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos),
    done AS (SELECT doc_id, coalesce(string_agg(p, {glue} ORDER BY i) FILTER (WHERE NOT cut), '') AS text, count(pos) AS {names[0]},
        count(*) FILTER (WHERE cut) AS {names[1]} FROM marked GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN coalesce({names[1]}, 0) = 0 THEN d.text ELSE done.text END AS text,
        coalesce({names[0]}, 0) AS {names[0]}, coalesce({names[1]}, 0) AS {names[1]} FROM documents d LEFT JOIN done USING (doc_id)"""


_LINE_WINDOWS = """SELECT a.doc_id, a.pos, 3 AS n, [a.k, b.k, c.k] AS h FROM filled a
    JOIN filled b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN filled c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2"""
# the shortest run of two or more sentences and twelve or more words
_SPAN_WINDOWS = r"""SELECT doc_id, pos, arg_min(h, n) AS h, min(n) AS n FROM (
    SELECT a.doc_id, a.pos, b.pos - a.pos + 1 AS n, list(b.k) OVER run AS h,
        sum(len(regexp_extract_all(b.k, '[^ \t\n\x0B\f\r]+'))) OVER run AS words
    FROM filled a JOIN filled b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + 11
    WINDOW run AS (PARTITION BY a.doc_id, a.pos ORDER BY b.pos)) WHERE n >= 2 AND words >= 12 GROUP BY doc_id, pos"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_span_dedup": op8_span_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_files": op10_token_files,
    "op11_spelling": op11_spelling,
    "op12_language": op12_language,
    "op13_resampling": op13_resampling,
}


def _crc_sql(digits: str) -> str:
    """CRC-32 of the bytes with these hexadecimal digits."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    octets = f"list_transform(range(0, CAST(length({digits}) / 2 AS bigint)), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS bigint))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1]), 4294967295))"


_SPELLING_SQL = rf"""
    WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
    each AS (SELECT w, hex(coalesce(CAST(doc_id AS varchar), '') || ':' || w) AS b, count(*) AS n FROM run GROUP BY doc_id, w),
    hashed AS (SELECT w, n, {_crc_sql("b")} AS h FROM each),
    cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS bigint)) || substr(w, CAST(h % length(w) AS bigint) + 2) ELSE w END AS word, n FROM hashed),
    v AS MATERIALIZED (SELECT word, CAST(sum(n) AS bigint) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    gone AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
    near AS (SELECT g.word AS a, v.word AS b FROM gone g JOIN v ON v.word = g.rest UNION SELECT v.word, g.word FROM gone g JOIN v ON v.word = g.rest
        UNION SELECT x.word, y.word FROM gone x JOIN gone y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
    best AS (SELECT a, count(*) AS n_near, max(n) AS best_n, arg_min(b, (-n, b)) AS best FROM near JOIN v ON v.word = b GROUP BY a),
    formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
        FROM v LEFT JOIN best ON a = word),
    way AS (SELECT word, word AS at FROM formed UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN way ON way.word = f.word JOIN formed e ON e.word = way.at WHERE e.form IS NULL"""


_RESAMPLING_SQL = rf"""
    WITH t AS (SELECT doc_id AS id, TRUE AS own, coalesce(text, '') AS text FROM documents UNION ALL SELECT item_id, FALSE, coalesce(text, '') FROM benchmark),
    l AS (SELECT id, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
    g AS (SELECT id, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM l),
    d AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM g)),
    b AS (SELECT f, {_crc_sql("h")} % 10000 AS bucket FROM d),
    c AS (SELECT id, own, bucket, count(*) AS n FROM g JOIN b USING (f) GROUP BY ALL),
    a AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t FROM c GROUP BY bucket),
    k AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS double) * CAST((SELECT sum(s) FROM a) + 10000 AS double))
        / (CAST(s + 1 AS double) * CAST((SELECT sum(t) FROM a) + 10000 AS double)))) AS bigint) AS gain FROM a),
    w AS (SELECT id, CAST(sum(n) AS bigint) AS n_features, CAST(sum(n * gain) AS bigint) AS weight FROM c JOIN k USING (bucket) WHERE own GROUP BY id),
    x AS (SELECT l.id AS doc_id, len(l.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || l.id), 1, 8) AS bigint) + CAST(0.5 AS double)) / 4294967296))) AS bigint) AS score
        FROM l LEFT JOIN w ON l.id = w.id WHERE own),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""

_RULES_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS words FROM d),
    word AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
    three AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS copies FROM three WHERE c IS NOT NULL),
    rep AS (SELECT doc_id, count(DISTINCT i + step) AS n FROM win, (VALUES (0), (1), (2)) AS s(step) WHERE copies > 1 GROUP BY doc_id),
    line AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line GROUP BY doc_id),
    bare AS (SELECT doc_id, regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS t FROM line),
    size AS (SELECT doc_id, t, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS n FROM bare),
    lost AS (SELECT doc_id, sum(n) AS n FROM size WHERE len(regexp_extract_all(t, '[|»›•·→]')) >= n * 0.2
        OR len(regexp_extract_all(t, '[#*$%&|<>]')) > (length(t) - n + 1) * 0.1
        OR (length(t) - n + 1 >= 12 AND len(regexp_extract_all(t, '\p{Lu}')) > (length(t) - n + 1) * 0.6)
        OR n < 12 AND NOT regexp_matches(t, '[.!?:;…。！？]["''”’»)\]]*\s*$')
        OR regexp_matches(t, '(?i)\b(?:all rights reserved|copyright \S*\s?\d{4}|licensed under|terms (?:of|and) (?:use|service|conditions)|privacy policy|cookie (?:policy|settings)|uses? cookies|javascript|lorem ipsum|click here|read more|sign (?:in|up)|log ?in|subscribe)\b')
        GROUP BY doc_id),
    base AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS bigint) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        CAST(coalesce(lost.n, 0) AS bigint) AS lost_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
    SELECT *, NOT base_failed AND lost_words <= n_words * 0.5 AS kept FROM judged"""


ORACLES = {
    "op11_spelling": _SPELLING_SQL,
    "op13_resampling": _RESAMPLING_SQL,
    "op6_quality_rules": _RULES_SQL,
    "op3_line_dedup": _repeat_sql("string_split(text, chr(10))", f"trim(translate(p, {_SPACES}, '    '))", "chr(10)", ("n_lines", "n_removed"), _LINE_WINDOWS),
    "op8_span_dedup": _repeat_sql(
        # a control character marks the ends of sentences
        r"flatten(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?][ \t\r\n]|\n)([^ \t\r\n])', '\1' || chr(1) || '\2', 'g'), '([.!?][ \t\r\n]|\n)([^ \t\r\n" + "\x01" + r"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: CASE WHEN len(regexp_extract_all(s, '[^ \t\n\x0B\f\r]+')) > 24"
        r" THEN string_split(regexp_replace(s, '([,;:nt] )', '\1' || chr(2), 'g'), chr(2)) ELSE [s] END))",
        f"trim(translate(p, {_SPACES} || chr(10), '     '))",
        "''",
        ("n_sentences", "n_removed"),
        _SPAN_WINDOWS,
    ),
}
