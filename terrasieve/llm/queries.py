"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, crf, langid, lattice, licenses, mixing, neardup, packing, rules, shards

QUERIES = {
    "op1_rendezvous_sharding": shards.op1_rendezvous_sharding,
    "op2_fuzzy_license_scan": licenses.op2_fuzzy_license_scan,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_inverted_multi_index": ann.op4_inverted_multi_index,
    "op5_crf_quality": crf.op5_crf_quality,
    "op6_bottom_k_near_duplicates": neardup.op6_bottom_k_near_duplicates,
    "op7_length_packing": packing.op7_length_packing,
    "op8_hyperdimensional_language": langid.op8_hyperdimensional_language,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_subword_lattice": lattice.op10_subword_lattice,
}

_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in rules.STOP_WORDS.values() for w in words.split()}))

ORACLE_SQL = {
    "op3_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls
  FROM d
), tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM tri) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_exclamations,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN cov USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2.0::DOUBLE AND 14.0::DOUBLE
         AND n_symbols / n_words <= 0.10::DOUBLE AND n_upper / word_chars <= 0.30::DOUBLE
         AND n_exclamations / n_words <= 0.10::DOUBLE AND n_stop_words / n_words >= 0.03::DOUBLE
         AND n_dup_lines / n_lines <= 0.50::DOUBLE AND n_repeat_words / n_words <= 0.45::DOUBLE, true) AS kept
FROM v
""",
    "op6_bottom_k_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), n AS (
  SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(id, c) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT b, r.c FROM r JOIN both_ways ON r.id = a WHERE r.c < b
), m AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON doc_id = id
""",
}
