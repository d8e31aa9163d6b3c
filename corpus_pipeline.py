"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

    quality      documents that the quality rules reject go
    duplicates   of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) one document stays
    benchmark    documents that hold a benchmark item go
    privacy      personal data is removed from the texts, and terms that disclose it are generalised
    tokens       texts become SentencePiece ids

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbolist.llm import decontaminate, pii, quality_rules, sentencepiece_codec, signature_tree
from arbolist.llm.common import shared_dir, tables, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature_tree.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, tables(sf_dir, spark, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of documents named n_tokens, token_ids or lossless are replaced by the stage's own."""
    return sentencepiece_codec.encode(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))


STAGES = [("quality", quality), ("duplicates", duplicates), ("benchmark", benchmark), ("privacy", privacy), ("tokens", tokens)]
#: The model-based stages and SentencePiece have no SQL form. The tests hold run() against a plain version of its stages, in which
#: duplicates, matches of benchmark items and tokens are found by loops over all texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs, folder = tables(sf_dir, spark, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
