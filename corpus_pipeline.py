"""Stages that turn raw documents into packed training sequences.

Each stage takes the documents that its predecessor kept and returns such
documents; the last returns the pieces of the packed sequences.

Defined cases, of every stage: null and empty texts fail the quality rules; a
null doc_id, source or lang is a value like others (the language that a
document claims is learned from, never trusted); very long texts are worked on
whole; rows that are alike are judged alike, and one of them stays behind the
third stage; further columns, whatever their names, go along, and n_chars, if
there, follows the text; an empty table passes as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import written_alone
from vellum.llm.language import keep_sure
from vellum.llm.mixing import mixed_documents
from vellum.llm.ngram_join import one_of_each_group
from vellum.llm.packing import pack_documents
from vellum.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are more likely good than bad."""
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a probability of a half or more."""
    return keep_sure(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word five-grams of a similarity of 0.8 link."""
    return one_of_each_group(docs, n=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language identification", language_id),
    ("n-gram near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("packing", packing),
]

#: The recurrent network and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each result is stored and read again, and what it was made from deleted."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"), path)
    return docs
