"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, fingerprint, importance, language_id, license_scan, manifest, mixing, near_dedup, passages, simhash, suffix_dedup,
               toxicity, warc)
from .common import table


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op10_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, table(spark, sf_dir, "pages"))


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op2_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op4_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents")).drop("start_byte", "end_byte")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_importance_resampling": op13_importance_resampling,
    "op4_chained_passages": op4_chained_passages,
    "op1_license_scan": op1_license_scan,
    "op2_rank_order_language_id": op2_rank_order_language_id,
    "op5_multiset_fingerprint": op5_multiset_fingerprint,
    "op10_warc_roundtrip": op10_warc_roundtrip,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op3_noisy_or_toxicity": op3_noisy_or_toxicity,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op6_setsketch_near_dedup": op6_setsketch_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
}

ORACLE = {
    "op11_merkle_manifest": manifest.oracle(),
    "op13_importance_resampling": importance.oracle(),
    "op1_license_scan": license_scan.oracle(),
    "op10_warc_roundtrip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
t AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d LEFT JOIN t ON d.payload_digest = t.payload_digest AND d.payload_bytes = t.payload_bytes""",
    "op8_pfair_mixing": """
WITH RECURSIVE k AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS src,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS md FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md, doc_id) - 1 AS rk FROM k),
sz AS (SELECT src, count(*) AS n_docs, pow(count(*), 0.85) AS w FROM k GROUP BY src),
s1 AS (SELECT *, CAST(CASE WHEN count(*) OVER () * 8 <= 1024 THEN 1024
                      ELSE pow(2, ceil(log2(count(*) OVER () * 8))) END AS BIGINT) AS q FROM sz),
s2 AS (SELECT *, q * w / sum(w) OVER () AS raw FROM s1),
s3 AS (SELECT *, CAST(greatest(1, floor(raw)) AS BIGINT) AS base FROM s2),
s4 AS (SELECT *, q - sum(base) OVER () AS lft, row_number() OVER (ORDER BY raw - base DESC, src) AS up,
              row_number() OVER (ORDER BY base DESC, src) AS down FROM s3),
sh AS (SELECT src, q, CAST(ceil(n_docs / 16) AS BIGINT) AS nb, row_number() OVER (ORDER BY src) AS i,
              CAST(base + CASE WHEN up <= lft THEN 1 WHEN down <= -lft THEN -1 ELSE 0 END AS BIGINT) AS e FROM s4),
cfg AS (SELECT max(q) AS q, list(e ORDER BY i) AS es FROM sh HAVING count(*) > 0),
sim AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(es, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, q, es FROM cfg
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(es) + 1), lambda j: done[j] + CASE WHEN j = p THEN 1 ELSE 0 END), p, q, es
  FROM (SELECT t, done, q, es, list_position(d, list_min(d)) AS p
        FROM (SELECT t, done, q, es, list_transform(range(1, len(es) + 1),
                     lambda j: CASE WHEN (done[j] * q) // es[j] <= t + 1 THEN ((done[j] + 1) * q + es[j] - 1) // es[j]
                               ELSE 4611686018427387904 END) AS d
              FROM sim WHERE t + 1 < q))),
pat AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) AS c FROM sim WHERE t >= 0),
lim AS (SELECT max((nb * q + e - 1) // e) AS cover, min((nb * q) // e) AS even FROM sh),
occ AS (
  SELECT src, i, e, q, nb, cover, even, unnest(range(1, nb * CAST(ceil(((cover * e) // q + 1) / nb) AS BIGINT) + 1)) AS g
  FROM sh, lim),
sl AS (
  SELECT occ.*, (g - 1) // nb + 1 AS epoch, (g - 1) % nb + 1 AS block, ((g - 1) // e) * q + t AS slot
  FROM occ JOIN pat ON pat.i = occ.i AND pat.c = (g - 1) % e + 1)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, CAST(rk % 16 + 1 AS BIGINT) AS block_row,
       e AS share, q AS period, CAST(((g - 1) * q) // e AS BIGINT) AS release,
       CAST((g * q + e - 1) // e AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot, slot < even AS balanced
FROM r JOIN sl ON r.src = sl.src AND r.rk // 16 + 1 = sl.block
WHERE slot < cover OR epoch = 1""",
    "op9_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bwin),
dwin AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
hits AS (SELECT doc_id, i, dwin.l AS l, item_id FROM dwin JOIN bwin ON dwin.s = bwin.s AND dwin.l = bwin.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
