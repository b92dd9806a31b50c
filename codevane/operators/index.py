"""Bags of codes: term frequencies, postings and statistics of an index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codevane.sources.tables import scratch, write_artefact

#: Words that are sent to every task at most, to leave out others; with more, all words of a text are kept.
SENT_WORDS = 1 << 20


def term_frequency(codes: DataFrame, key: str = "id", weighting: str = "tf") -> DataFrame:
    """(key, code, weight): how often each code stands in an item, or 1 with ``binary``."""
    if weighting not in ("tf", "binary"):
        raise ValueError("weighting must be tf or binary")
    counts = codes.groupBy(key, "code").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counts if weighting == "tf" else counts.withColumn("weight", F.lit(1.0))


def checked_vocabulary(codes: DataFrame, vocabulary: int) -> DataFrame:
    """codes, or an error if one is outside 0 to vocabulary-1."""
    if vocabulary is None or vocabulary < 1:
        raise ValueError("a vocabulary size is needed")
    ok = F.assert_true(F.col("code").between(0, vocabulary - 1), F.lit("a code is outside the vocabulary"))
    return codes.where(ok.isNull())


def postings(terms: DataFrame, key: str = "id") -> DataFrame:
    """(code, df, postings): for each code its items, heaviest first, the least id first among equals.

    For looking at an index.  Search joins the long form, where a list is never
    held in one row.
    """
    entry = F.struct((-F.abs("weight")).alias("o"), F.col(key), "weight")
    lists = F.array_sort(F.collect_list(entry))
    return terms.groupBy("code").agg(F.count(F.lit(1)).alias("df"), F.transform(lists, lambda x: F.struct(x[key].alias(key), x["weight"].alias("weight"))).alias("postings"))


def from_postings(index: DataFrame, key: str = "id") -> DataFrame:
    """The long form of ``postings``."""
    return index.select("code", F.explode("postings").alias("p")).select(F.col(f"p.{key}").alias(key), "code", F.col("p.weight").alias("weight"))


def vocabulary_stats(terms: DataFrame, key: str = "id") -> DataFrame:
    """(code, df, cf): items with the code, and its weight in all."""
    return terms.groupBy("code").agg(F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf"))


def sparsity(terms: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """(items, mean_nonzero): positive weights an item has on average, items without any included."""
    own = terms.where("weight > 0").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return items.select(key).join(own, key, "left").agg(F.count(F.lit(1)).alias("items"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_nonzero"))


def lengths(terms: DataFrame, key: str = "id") -> DataFrame:
    return terms.groupBy(key).agg(F.sum("weight").alias("length"))


def bm25(terms: DataFrame, key: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """terms with BM25 weights for a query of weight 1; corpus counts are aggregates of the terms."""
    size = lengths(terms, key)
    stats = size.agg(F.count(F.lit(1)).alias("n_items"), F.avg("length").alias("mean_length"))
    seen = vocabulary_stats(terms, key).select("code", "df")
    idf = F.log1p((F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("weight") * (k1 + 1) / (F.col("weight") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return terms.join(size, key).join(seen, "code").crossJoin(F.broadcast(stats)).select(key, "code", (idf * tf).alias("weight"))


def bags(texts: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """(key, length, terms): of each text (key, text) the number of its words between single blanks, and how often those of ``words`` (code) stand in it.

    Texts without words have no row.  A text is split where it is read; rows of
    one key are put together afterwards.
    """
    spark, kind = texts.sparkSession, dict(texts.dtypes)[key]
    known = words.select("code").where("code <> ''").distinct().limit(SENT_WORDS + 1).toArrow().column(0).to_pylist()
    held = spark.sparkContext.broadcast(frozenset(known) if len(known) <= SENT_WORDS else None)
    entries = pa.list_(pa.struct([("code", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = held.value
        for b in batches:
            length, size, codes, weights = [], [0], [], []
            for text in b.column(1):
                split = (text.as_py() or "").split(" ")
                length.append(len(split) - split.count(""))
                n = Counter(filter(None if some is None else some.__contains__, split))
                codes += n
                weights += n.values()
                size.append(len(codes))
            flat = pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(weights, pa.float64())], fields=list(entries.value_type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.float64()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat, type=entries)], names=[key, "length", "terms"])

    made = texts.select(key, "text").mapInArrow(run, f"`{key}` {kind}, length double, terms array<struct<code:string,weight:double>>")
    made = write_artefact(made.where("length > 0"), scratch(spark))
    again = made.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("__again"))
    if again.isEmpty():
        return made
    both = F.col(key).eqNullSafe(F.col("__again"))
    many = made.join(again, both, "left_semi")
    size = many.groupBy(key).agg(F.sum("length").alias("length"))
    terms = many.select(key, F.explode("terms").alias("t")).groupBy(key, "t.code").agg(F.sum("t.weight").alias("weight")).groupBy(key).agg(F.collect_list(F.struct("code", "weight")).alias("terms"))
    terms = terms.withColumnRenamed(key, "__again")
    whole = size.join(terms, both, "left").select(key, "length", F.coalesce("terms", F.array().cast(dict(made.dtypes)["terms"])).alias("terms"))
    return made.join(again, both, "left_anti").unionByName(whole)


def bm25_bags(found: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """``bags`` with the part of BM25 weights that an item decides, and (code, idf), the part that a code decides."""
    stats = found.agg(F.count(F.lit(1)).alias("n_items"), F.avg("length").alias("mean_length"))
    seen = found.select(F.explode("terms.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean_length"))
    tf = F.transform("terms", lambda t: F.struct(t.code.alias("code"), (t.weight * (k1 + 1) / (t.weight + norm)).alias("weight")))
    return found.crossJoin(F.broadcast(stats)).withColumn("terms", tf).drop("n_items", "mean_length"), seen.crossJoin(F.broadcast(stats)).select("code", idf.alias("idf"))


def most(terms: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k weights of largest size of each item, signs kept; the least code first among equals."""
    w = Window.partitionBy(key).orderBy(F.abs("weight").desc(), "code")
    return terms.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
