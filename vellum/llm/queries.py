"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import mixing, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), memory=900_000)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import searched

    return searched(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grading import graded, rated

    return graded(_table(spark, sf_dir, "documents"), rated(_table(spark, sf_dir, "labels")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_groups

    return ngram_groups(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identified

    return identified(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), memory=900_000)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import scored

    return scored(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_ngram_join": op4_ngram_join,
    "op5_mixing": op5_mixing,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_files": op9_token_files,
    "op10_url_filter": op10_url_filter,
}
ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op8_quality_rules": quality.oracle()}
