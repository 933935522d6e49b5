"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fixity, html_extraction, licenses, packing, prefix_trie, quality_classifier, quality_rules, runs, sharding, simhash, token_store, topk
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as records, against a replica of them with known faults."""
    records = fixity.records(table(spark, sf_dir, "pages"))
    found = fixity.audit(records, fixity.damaged(records))
    return found.select(found.record.alias("page_id"), "file", "offset", "length", "kind")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(spark, docs))
    return found.select("doc_id", "paragraph", "family", "predicted", "probability", "similarity", "confirmed")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_map(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(table(spark, sf_dir, "documents"))
    return token_store.documents(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.planted(prefix_trie.numbered(table(spark, sf_dir, "conversations"))))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_OP4 = """
WITH records AS (
  SELECT page_id, CAST(floor(page_id / 4096.0) AS BIGINT) AS file, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS tag,
         strlen('WARC/1.0') + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Record-ID: <urn:page:' || page_id || '>') + 2
         + strlen('WARC-Target-URI: ' || coalesce(url, '')) + 2 + strlen('Content-Length: ' || strlen(coalesce(html, ''))) + 4
         + strlen(coalesce(html, '')) + 4 AS length
  FROM pages),
placed AS (
  SELECT *, sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length AS begin FROM records)
SELECT page_id, file, CAST(begin AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
       CASE tag WHEN '00' THEN 'missing' ELSE 'changed' END AS kind
FROM placed WHERE tag IN ('00', '01', '02')
"""


_OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


# crc32 bit by bit: 3988292384 is its polynomial, and each id starts from and ends with all bits turned
_OP13 = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS rn, coalesce(role, '') AS role, coalesce("text", '') AS txt
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS UBIGINT) AS v FROM turns
  UNION ALL
  SELECT conv_id, s, k + 1, xor(x >> 1, (x & 1) * 3988292384)
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ord(s[k // 8 + 1]) AS UBIGINT)) ELSE v END AS x FROM bits WHERE k < 8 * length(s))),
convs AS (
  SELECT conv_id, xor(v, CAST(4294967295 AS UBIGINT)) % 4 AS h, conv_id - conv_id % 20 AS base FROM bits WHERE k = 8 * length(s)),
rebuilt AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.own, t.rn) AS d, t.role, t.txt
  FROM convs c JOIN (SELECT conv_id, rn, role, txt, false AS own FROM turns UNION ALL SELECT conv_id, rn, role, txt, true FROM turns) t
    ON (NOT t.own AND t.conv_id = c.base AND t.rn <= c.h) OR (t.own AND t.conv_id = c.conv_id AND t.rn > c.h)),
paths AS (
  SELECT conv_id, d, txt, list(sha256(role || chr(1) || txt)) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', CAST([] AS VARCHAR[]) FROM convs),
ends AS (SELECT conv_id, max_by(p, d) AS p FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len(regexp_extract_all(txt, '[^ 	-]+'))) AS saved
  FROM paths GROUP BY p, d),
kids AS (SELECT p[:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.p = k.p),
up AS (SELECT p[:u] AS p, saved, n_children FROM (SELECT *, unnest(range(d + 1)) AS u FROM full_)),
sums AS (SELECT p, sum(saved) AS saved_tokens, count(CASE WHEN n_children = 0 THEN 1 END) AS n_leaves FROM up GROUP BY p),
members AS (SELECT p, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM ends GROUP BY p)
SELECT f.conv_id, f.d AS depth, b.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(m.ids, '')) AS ends_sha256
FROM full_ f JOIN sums s ON f.p = s.p LEFT JOIN nodes b ON f.d > 0 AND b.p = f.p[:f.d - 1] LEFT JOIN members m ON m.p = f.p
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_fixity_audit": _OP4, "op11_threshold_topk": _OP11, "op13_prefix_trie": _OP13}
