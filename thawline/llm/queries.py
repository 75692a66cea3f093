"""The contract queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), window=50, with_text=False)


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import learn, predict
    from .toxicity import split_of

    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.where(~split_of("doc_id"))), ["doc_id"])
    return found.select("doc_id", split_of("doc_id").alias("held_out"), "lang_pred", "score")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_texts, split_of

    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", split_of("doc_id").alias("held_out"), "score", "predicted")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_shards import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"), shards=16)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_items

    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.inline("hits"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_approximate_nearest_neighbours": op3_approximate_nearest_neighbours,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_license_scans": op10_license_scans,
}

#: Windows are compared as joined strings here; a window starts at every word that has 49 more after it.
_OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first_doc FROM k),
g AS (SELECT doc_id, unnest(range(p, p + 50)) AS p FROM f WHERE first_doc < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM g GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""

#: All pairs that share a shingle, then the least doc_id over links by repeated closure.
_OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
links AS (SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2) o
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

#: CRC-32 of each byte, by its rule.
_CRC = [functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]


def _op7_sql(shards: int = 16, bits: int = 8) -> str:
    """Cells by the same integer rules, then one step down the curve a level, then one sort."""
    from .hilbert_shards import gray_tables

    rank, entry, turn = (f"({t}::BIGINT[])" for t in gray_tables(4))
    left = lambda x, by: f"((({x}) << (({by}) % 4)) | (({x}) >> (4 - ({by}) % 4))) & 15"
    leading = lambda c: f"CAST('0x' || rpad(hex(encode({c}))[1:12], 12, '0') AS BIGINT)"
    step = lambda c: f"({c} - min({c}) OVER ()) // greatest(1, (max({c}) OVER () - min({c}) OVER () + 4096) // 4096)"
    cell = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) - 1) * {1 << bits} // count({c}) OVER () END"
    sql = f"""WITH k AS (SELECT {_CRC}::BIGINT[] AS t), b AS (SELECT doc_id, coalesce(text, '') AS text, {leading('lang')} AS xl, {leading('source')} AS xs FROM documents),
r AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, xl, xs, coalesce(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
  lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295), 0) AS text_crc32 FROM b, k),
g AS (SELECT doc_id, size, text_crc32, {step('xl')} AS bl, {step('xs')} AS bs, {step('doc_id')} AS bd FROM r),
s0 AS (SELECT doc_id, size, text_crc32, least((length(bin(size)) - 1) * 8 + (((size * 8) >> (length(bin(size)) - 1)) & 7), 255)::BIGINT AS c0, {cell('bl')}::BIGINT AS c1, {cell('bs')}::BIGINT AS c2, {cell('bd')}::BIGINT AS c3, 0::BIGINT AS h, 0::BIGINT AS e, 0::BIGINT AS d FROM g)"""
    for level in range(bits - 1, -1, -1):
        at = bits - 1 - level
        corner = " | ".join(f"(((c{i} >> {level}) & 1) << {i})" for i in range(4))
        sql += f""",
w{at} AS (SELECT *, {rank}[1 + ({left(f"xor({corner}, e)", "4 - (d + 1) % 4")})] AS w FROM s{at}),
s{at + 1} AS (SELECT doc_id, size, text_crc32, c0, c1, c2, c3, h * 16 + w AS h, xor(e, {left(f"{entry}[1 + w]", "d + 1")}) AS e, (d + {turn}[1 + w] + 1) % 4 AS d FROM w{at})"""
    return (
        sql
        + f""",
n AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS p, count(*) OVER () AS total FROM s{bits}),
z AS (SELECT *, p * {shards} // total AS shard FROM n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (p - (shard * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM z"""
    )


ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": _OP2_SQL,
    "op5_ngram_jaccard_join": _OP5_SQL,
    "op7_hilbert_sharding": _op7_sql(),
}
