"""MRR, NDCG and recall of a run against binary judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (10, 100, 1000), universe: str = "qrels") -> DataFrame:
    """(qid, metric, k, value) for every judged query, or with ``run`` for those in the run.

    A query without results scores 0; repeated judgements count once.
    """
    judged = qrels.select("qid", "pid").distinct()
    n = judged.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    marked = run.join(judged.withColumn("hit", F.lit(True)), ["qid", "pid"], "left" if universe == "run" else "inner")
    return _scored(marked.select("qid", "rank", "hit"), n, ks, universe)


def per_labelled_query(run: DataFrame, queries: DataFrame, passages: DataFrame, ks: tuple[int, ...] = (10, 100, 1000), universe: str = "qrels", own: bool = True) -> DataFrame:
    """As ``per_query``, where the passages (pid, label) with a query's (qid, label) are its judgements.

    An id has one label.  Judged pairs grow with the square of a label's items
    and are not made: they are counted by label, and a result is judged by its
    own label.  With ``own`` off a query is no judgement of itself.
    """
    asked, known = queries.select("qid", "label").distinct(), passages.select("pid", "label").distinct()
    n = asked.join(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    if not own:
        itself = known.select(F.col("pid").alias("qid"), "label", F.lit(1).alias("one"))
        n = n.join(itself, ["qid", "label"], "left").withColumn("n", F.col("n") - F.coalesce("one", F.lit(0)))
    how = "left" if universe == "run" else "inner"
    both = run.join(known.withColumnRenamed("label", "has"), "pid", how).join(asked.withColumnRenamed("label", "wants"), "qid", how)
    hit = F.col("has") == F.col("wants")
    marked = both.select("qid", "rank", (hit if own else hit & (F.col("qid") != F.col("pid"))).alias("hit"))
    return _scored(marked, n.where("n > 0").select("qid", "n"), ks, universe)


def _scored(marked: DataFrame, n: DataFrame, ks: tuple[int, ...], universe: str) -> DataFrame:
    """(qid, metric, k, value) of results (qid, rank, hit) and the number of judgements (qid, n)."""
    if universe not in ("qrels", "run"):
        raise ValueError("universe must be qrels or run")
    aggs = []
    for k in ks:
        on = F.col("hit") & (F.col("rank") <= k)
        aggs += [
            F.max(F.when(on, 1.0 / F.col("rank"))).alias(f"mrr_{k}"),
            F.sum(F.when(on, 1.0 / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}"),
            F.sum(F.when(on, 1.0)).alias(f"hits_{k}"),
        ]
    found = marked.groupBy("qid").agg(*aggs)
    rows = (found.join(n, "qid", "left") if universe == "run" else n.join(found, "qid", "left")).withColumn("n", F.coalesce("n", F.lit(0)))
    entries = []
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
        some = F.col("n") > 0
        for name, value in (
            ("mrr", F.col(f"mrr_{k}")),
            ("ndcg", F.when(some, F.col(f"dcg_{k}") / F.when(some, ideal))),
            ("recall", F.when(some, F.col(f"hits_{k}") / F.col("n"))),
        ):
            entries.append(F.struct(F.lit(name).alias("metric"), F.lit(k).alias("k"), F.coalesce(value, F.lit(0.0)).alias("value")))
    return rows.select("qid", F.explode(F.array(*entries)).alias("e")).select("qid", "e.metric", "e.k", "e.value")


def evaluate(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (10, 100, 1000), universe: str = "qrels") -> DataFrame:
    """(metric, k, value): means over queries."""
    return means(per_query(run, qrels, ks, universe))


def means(values: DataFrame) -> DataFrame:
    """(metric, k, value) of rows (qid, metric, k, value)."""
    return values.groupBy("metric", "k").agg(F.avg("value").alias("value"))
