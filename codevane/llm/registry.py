"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codevane.llm import bpe, language, licenses, mixing, pii, quality, sharding, similarity, store, substrings, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(table(spark, sf_dir, "embeddings"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.digest(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_topk": op2_topk,
    "op3_jaccard": op3_jaccard,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_bpe": op10_bpe,
}

SQL: dict[str, str] = {
    "op2_topk": topk.SQL,
    "op3_jaccard": similarity.SQL,
    "op8_quality": quality.SQL,
    "op9_substrings": substrings.SQL,
}
