"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spliceloom.llm import pii, quality, toxicity
from spliceloom.llm.bpe import encoded
from spliceloom.llm.decontaminate import leaks
from spliceloom.llm.exact_dedup import exact_groups
from spliceloom.llm.fingerprint import alike_documents, edited_fingerprints
from spliceloom.llm.html_extract import extracted
from spliceloom.llm.license_scan import scanned
from spliceloom.llm.near_dedup import near_duplicates
from spliceloom.llm.periodic import periodic_runs
from spliceloom.llm.repeats import deduplicated
from spliceloom.llm.spelling import spelling_variants


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 1: bands of the fingerprints' minima joined, and verified."""
    return alike_documents(_read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(_read(spark, sf_dir, "documents")).drop("kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scanned(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_read(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(_read(spark, sf_dir, "documents")).drop("detections")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"), every=97)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_read(spark, sf_dir, "documents"), repeat=True).drop("n_words", "runs")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprint, fingerprint_classes, op2_quality, op3_repeats, op4_pii, op5_decontaminate, op6_near_dedup, op7_html_extract, op8_bpe, op9_license_scan, op10_toxicity, op11_spelling_variants, op12_periodic_runs, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    from spliceloom.llm import oracles

    return {k[: -len("_SQL")].lower(): v for k, v in vars(oracles).items() if k.endswith("_SQL")}
