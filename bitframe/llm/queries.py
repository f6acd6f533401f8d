"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprint, licenses, linededup, maintext, merkle, minhash, mixing, pii, quality, runs, sentencepiece, toxicity


def _on(table: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _on("documents", pii.report),
    "op2_quality": _on("documents", quality.report),
    "op3_toxicity": op3,
    "op4_sentencepiece": _on("documents", sentencepiece.report),
    "op5_minhash": _on("documents", minhash.near_duplicates),
    "op6_fingerprint": _on("documents", fingerprint.report),
    "op7_licenses": _on("documents", licenses.scan),
    "op8_mixing": _on("documents", lambda docs: mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")),
    "op9_chat": _on("conversations", chat.report),
    "op10_linededup": _on("documents", linededup.report),
    "op11_maintext": _on("pages", maintext.main_text),
    "op12_merkle": _on("documents", merkle.report),
    "op13_runs": _on("documents", runs.report),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')"

OP2_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
grams AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM docs WHERE len(w) > 2),
keyed AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS c FROM grams),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS j FROM keyed WHERE c > 1) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^ \t\n\v\f\r]') GROUP BY r),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines FROM docs LEFT JOIN repeats p USING (r) LEFT JOIN lines l USING (r)),
bins AS (SELECT *, least(1000, 1000 * n_symbols // greatest(word_chars, 1)) AS symbols, least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)) AS dup_lines,
  least(1000, 1000 * n_repeat_words // greatest(n_words, 1)) AS repeats, least(1000, 10 * word_chars // greatest(n_words, 1)) AS word_length FROM counts),
long AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS m, unnest([symbols, dup_lines, repeats, word_length]) AS b FROM bins),
own AS (SELECT lang, source, m, count(*) AS total, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3 FROM long GROUP BY ALL),
of_lang AS (SELECT lang, m, count(*) AS total, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3 FROM long GROUP BY ALL),
of_all AS (SELECT m, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3 FROM long GROUP BY ALL),
picked AS (SELECT o.lang, o.source, o.m, CASE WHEN o.total >= 50 THEN o.q2 WHEN l.total >= 50 THEN l.q2 ELSE a.q2 END AS q2,
  3 * CASE WHEN o.total >= 50 THEN o.q3 - o.q1 WHEN l.total >= 50 THEN l.q3 - l.q1 ELSE a.q3 - a.q1 END AS reach
  FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m JOIN of_all a ON o.m = a.m),
limits AS (SELECT lang, source, max(q2 + greatest(reach, 50)) FILTER (m = 'symbols') AS s, max(q2 + greatest(reach, 400)) FILTER (m = 'dup_lines') AS d, max(q2 + greatest(reach, 350)) FILTER (m = 'repeats') AS p,
  max(q2 - greatest(reach, 20)) FILTER (m = 'word_length') AS lo, max(q2 + greatest(reach, 30)) FILTER (m = 'word_length') AS hi FROM picked GROUP BY ALL),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM bins)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbols <= s AND dup_lines <= d AND repeats <= p AND word_length BETWEEN lo AND hi AS kept
FROM failed f JOIN limits t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""

OP5_SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
  ELSE list_distinct([md5(concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4])) for i in range(1, len(w) - 3)]) END AS s FROM docs),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN sides l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM sizes JOIN reach ON doc_id = a GROUP BY doc_id, n
"""

ORACLE_SQL: dict[str, str] = {"op2_quality": OP2_SQL, "op5_minhash": OP5_SQL, "op10_linededup": linededup.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL}
