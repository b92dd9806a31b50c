"""A corpus from raw documents to token ids, in five stages.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last returns ids.  Results between stages are Parquet tables
in the shared folder, so a stage can be run again alone.

Defined results, for every stage: a null in any column is allowed and says what
each stage has for it; texts are worked on whole; a table without rows gives
none; columns beyond those of ``documents`` are left out, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevane.llm import bpe, language, mixing, pii, similarity, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of at least LONG characters goes if its language explains less of it than LEAST.
LONG, LEAST = 64, 0.2


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names each document's language; what has no letters, or is long and in no known language, goes.

    A label that the model could not learn is no unknown language: its documents
    keep it.  A null or empty text has no letters and goes; a null ``lang`` is
    filled in; repeated rows are judged alike and all stay; of languages that
    fit alike the first by code point is taken.
    """
    store.bounded(spark)
    docs = docs.select(*COLUMNS)
    model = language.fit(docs, training=F.lit(True))
    found = language.predict(docs, model)
    strange = (F.length("text") >= LONG) & (F.col("score") < LEAST)
    judged = F.col("lang").isNull() | F.col("lang").isin(list(model.languages))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & ~(judged & strange))
    return kept.withColumn("lang", F.when(judged, F.col("lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def unite(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least id stays.

    Rows that share an id are one document only if they share the text too; of
    them the one with the least other columns stays.  Rows without an id all
    stay, and so does every text without words: those are alike to nothing.
    """
    store.bounded(spark)
    docs, rule = docs.select(*COLUMNS), similarity.Rule(5, 80, 100)
    found = similarity.join(docs, rule)
    gone = store.written(found.where("component_id <> doc_id").select("doc_id").distinct())
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # an id is no key here: a hash of id and text is
    rows = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    rows = store.written(rows.select("doc_id", "text", "rest.*", F.xxhash64("doc_id", "text").alias("key")))
    found = similarity.join(rows.select(F.col("key").alias("doc_id"), "text"), rule).select(F.col("doc_id").alias("key"), "component_id")
    least = rows.select("doc_id", "key").join(found, "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    kept = rows.join(store.written(least.select("least.key")), "key", "left_semi")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; all rows stay, repeated ones too, and a null text stays null."""
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources to their target weights; a document taken twice is two rows.

    A null source is a source of its own; a null or empty text has no words and
    is taken in whole passes over its source; repeated rows are documents each.
    """
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, repeated ones too: doc_id, source, n_tokens, ids; a null text has none."""
    store.bounded(spark)
    done = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language identification", identify), ("near copies", unite), ("personal data", mask), ("mixing", mix), ("encoding", encode)]

#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.written(docs)
    return docs
