"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, packing, pii, pseudo_likelihood, sharding, simhash, substrings, telephony, toxicity, warc
from .common import table, tokenizer_file


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.described(table(spark, sf_dir, "documents"))


def op4_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = pseudo_likelihood.shards(table(spark, sf_dir, "documents"), tokenizer_file())
    return pseudo_likelihood.score(stored, pseudo_likelihood.train(stored))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bm25_packing, op2_warc_chunks, op3_telephony, op4_masked_likelihood, op5_simhash, op6_minimax_shards, op7_pii_boosting, op8_positional_index, op9_nonnegative_pu, op10_de_bruijn)}


_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN win USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM k),
lost AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(i, i + 20)) AS t(p) WHERE r > 1),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Twins where SQL has what the result needs; the others are tested in tests/llm."""
    return {"op2_warc_chunks": _WARC_SQL, "op8_positional_index": _CONTAMINATION_SQL, "op10_de_bruijn": _REPEATS_SQL}
