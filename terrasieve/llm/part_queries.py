"""What SQL can express of some corpus queries: their plain columns, all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries


def _part(of: str, *columns) -> Callable[[SparkSession, str], DataFrame]:
    """What SQL can express of a query: some of its columns, all of its rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return queries.QUERIES[of](spark, sf_dir).select(*[c() if callable(c) else c for c in columns])

    return run


QUERIES = {
    "shard_sizes": _part("op1_rendezvous_sharding", "doc_id", "size", "law", lambda: ((F.col("grown_shard") == 40) | (F.col("grown_shard") == F.col("shard"))).alias("only_into_new")),
    "license_base": _part("op2_fuzzy_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "packing_lengths": _part("op7_length_packing", "doc_id", "length", lambda: (F.col("boundary") - F.col("length") == F.col("padding")).alias("padded"), lambda: (F.col("padding") >= 0).alias("fits")),
    "mixing_targets": _part("op9_source_mixing", "doc_id", "size", "source_size", lambda: F.round("target", 4).alias("target"), lambda: (F.col("taken") <= 2 * F.col("size")).alias("within_twice")),
    "likelihood_base": _part("op10_subword_lattice", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", lambda: (F.round("base_score", 4) + 0.0).alias("base_score")),
}

#: crc32 of a number written in decimal, digit by digit and bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::UBIGINT)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def _places(phrase: str) -> str:
    """Places (from 0) where a phrase's words stand one after another in ws."""
    words = phrase.split()
    return f"list_filter(range(0, len(ws) - {len(words) - 1}), lambda i: {' AND '.join(f'ws[i + {k + 1}] = {chr(39)}{w}{chr(39)}' for k, w in enumerate(words))})"


ORACLE_SQL = {
    "shard_sizes": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, 'key' AS law, true AS only_into_new FROM documents",
    "license_base": f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, {', '.join(f'{_places(p)} AS p{i}' for i, (p, _) in enumerate(_PHRASES))} FROM w),
a AS (SELECT *, list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS pl FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(pl)::BIGINT AS n_base, list_min(pl) AS first_word, list_max(pl) AS last_word,
       array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(_PHRASES))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a
""",
    "packing_lengths": f"SELECT doc_id, len({_WORDS.format("coalesce(text, '')")}) + 1 AS length, true AS padded, true AS fits FROM documents",
    "mixing_targets": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 1.5 * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, 2 * source_size / weight AS ratio, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT arg_min((total - capped) / open, capped) FILTER ((total - capped) / open <= ratio) AS level FROM o),
t AS (SELECT source, source_size, least(2.0 * source_size, level * weight) AS target FROM o, l)
SELECT doc_id, size::BIGINT AS size, source_size, round(target::DOUBLE, 4) AS target, true AS within_twice FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
""",
    "likelihood_base": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS ws, coalesce({_CRC} % 7 = 2, false) AS held_out FROM documents),
t AS (SELECT r, held_out, unnest(list_append(ws, '')) AS w FROM d), c AS (SELECT w, count(*) FILTER (NOT held_out) AS c FROM t GROUP BY w), n AS (SELECT sum(c) AS n, count(*) FILTER (c > 0) AS v FROM c),
m AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10((c + 1.0::DOUBLE) / (n + v + 1))) AS base FROM t JOIN c USING (w), n GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n::BIGINT AS train_tokens, round(base, 4) + 0.0 AS base_score FROM d JOIN m USING (r), n
""",
}
