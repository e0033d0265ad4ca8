"""The queries of this subpackage, by operator, with their oracles."""

from __future__ import annotations

from . import decontamination, html_tree, language_id, license_scan, line_cleaning, near_dup, packing, pii, sharding, warc
from .common import table


def op1_decontamination(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark, sf_dir):
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.read_records(warc.write_records(table(spark, sf_dir, "pages")))


def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark), report=True)


def op9_line_cleaning(spark, sf_dir):
    return line_cleaning.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_html_tree(spark, sf_dir):
    return html_tree.extract(table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")} | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {"op3_warc": OP3, "op9_line_cleaning": line_cleaning.oracle()}


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS m FROM d)
SELECT f.page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 100 AND f.page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f.page_id <> m THEN m END AS refers_to,
       q.url AS target_uri, CAST(CASE WHEN n >= 100 AND f.page_id <> m THEN 1 ELSE greatest(1, ceil(n / 262144.0)) END AS INTEGER) AS n_chunks
FROM f JOIN (SELECT page_id, any_value(url) AS url FROM pages GROUP BY page_id) q ON f.page_id = q.page_id
"""
