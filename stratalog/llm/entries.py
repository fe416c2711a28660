"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stratalog.llm import oracles
from stratalog.llm.decontaminate import find_contamination
from stratalog.llm.language import predict_languages
from stratalog.llm.lines import dedup_report
from stratalog.llm.manifest import verified_manifest
from stratalog.llm.media import store_texts
from stratalog.llm.packing import pack
from stratalog.llm.pii import detect_pii
from stratalog.llm.quality import score_quality
from stratalog.llm.runs import run_report
from stratalog.llm.secrets import scan_secrets
from stratalog.llm.simhash import near_duplicates
from stratalog.llm.token_counts import count_tokens
from stratalog.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(_table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(_table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_media": op3_media,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
    "op11_runs": op11_runs,
    "op12_manifest": op12_manifest,
    "op13_language": op13_language,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op5_decontamination": oracles.DECONTAMINATION, "op9_warc": oracles.WARC, "op12_manifest": oracles.MANIFEST}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
