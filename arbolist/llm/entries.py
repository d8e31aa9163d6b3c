"""The registered queries of the training-data operators, with their SQL where SQL can express them.

Each reads whole tables; the digest columns of the queries are derived here from the operators' outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lang_id, pii, quality_net, quality_rules, sentencepiece_codec, signature_tree, toxicity, url_filter, warc
from .common import fold, tables


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held = tables(sf_dir, spark, "documents"), tables(sf_dir, spark, "labels"), fold("doc_id", 4) == 2
    return toxicity.tag(docs, toxicity.train(docs, labels, held), held)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_and_read(tables(sf_dir, spark, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(tables(sf_dir, spark, "documents"), tables(sf_dir, spark, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(tables(sf_dir, spark, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = tables(sf_dir, spark, "documents"), fold("doc_id", 4) == 2
    return lang_id.identify(docs, lang_id.train(docs, held), held)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(tables(sf_dir, spark, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(tables(sf_dir, spark, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(tables(sf_dir, spark, "documents"))


def op9_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.join(tables(sf_dir, spark, "documents"))


def op10_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held = tables(sf_dir, spark, "documents"), tables(sf_dir, spark, "labels"), fold("doc_id", 3) == 1
    table = quality_net.context_table(docs)
    return quality_net.classify(docs, quality_net.train(docs, labels, held, table), table, held)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_decontaminate, op4_url_filter, op5_language_id, op6_quality_rules, op7_sentencepiece, op8_pii, op9_signature_tree, op10_quality_net)}


ORACLE = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
        f AS (SELECT s, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY s)
        SELECT d.page_id, d.n AS payload_bytes, d.s AS payload_digest,
               CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.s = f.s""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
