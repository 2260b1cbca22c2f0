"""Corpus preparation: quality, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its rows are written as a table
and read again as the next one's docs. All but the last return the columns of documents, of whatever type and with all
others that docs has. Null and empty texts go the way of any other: they are scored, are nobody's duplicate, leak nothing, hold
no personal data and have no tokens. Of rows with one doc_id the near-duplicate stage keeps one, by text; rows without
doc_id all stay. An empty table gives no rows, and an empty labels or benchmark table rejects none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spliceloom.llm import bpe, decontaminate, near_dedup, pii, quality
from spliceloom.llm.queries import tokenizer_path
from spliceloom.staging import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones among docs, does not reject."""
    return quality.filtered(docs, _table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near-duplicates (five words, 0.8)."""
    return near_dedup.one_of_each(docs)


def no_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, verbatim or edited."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the terms that reveal it, generalised to their kind."""
    return pii.sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text decoded from them."""
    return bpe.encoded(docs, tokenizer_path())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontamination", no_benchmark_leaks),
    ("pii", no_personal_data),
    ("bpe", tokens),
]

#: Learned scores, random walks and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
