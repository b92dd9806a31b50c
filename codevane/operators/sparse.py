"""The learned sparse projection, its index filters and its losses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevane.functions.vectors import activation
from codevane.operators.index import most
from codevane.operators.quantize import matrix
from codevane.operators.search import SEARCH_ROWS, Terms, column, over_blocks

#: Weights at or below this are not indexed.
LEAST = 1e-5


@dataclass(frozen=True)
class Projection:
    """weight[i, j] from input i to output j, and a bias; output is min(log(1 + relu(xW + b)), most)."""

    weight: np.ndarray
    bias: np.ndarray
    most: float = 10.0

    @classmethod
    def initial(cls, d: int, outputs: int, seed: int = 0) -> Projection:
        """Uniform in the range that keeps variance, no bias."""
        bound = (6 / (d + outputs)) ** 0.5
        return cls(np.random.default_rng(seed).uniform(-bound, bound, (d, outputs)), np.zeros(outputs))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.log1p(np.maximum(x @ self.weight + self.bias, 0)), self.most)

    def gradient(self, x: np.ndarray, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of weight and bias from that of the output."""
        s = x @ self.weight + self.bias
        ds = upstream * ((s > 0) & (np.log1p(np.maximum(s, 0)) < self.most)) / (1 + np.maximum(s, 0))
        return x.T @ ds, ds.sum(axis=0)


def project(vectors: DataFrame, p: Projection, key: str = "id", vector: str = "embedding", k: int | None = None) -> DataFrame:
    """(key, code, weight): the positive outputs of each vector, or its k largest."""
    held = vectors.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            if not b.num_rows:
                continue
            y = p.apply(matrix(b.column(1).cast(pa.list_(pa.float64()))))
            if k is not None and k < y.shape[1]:
                # largest first, the lesser output first among equals
                rank = np.argsort(np.argsort(-y, axis=1, kind="stable"), axis=1, kind="stable")
                y = np.where(rank < k, y, 0)
            i, j = np.nonzero(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(y[i, j])], names=[key, "code", "weight"])

    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {dict(vectors.dtypes)[key]}, code int, weight double")


def project_sql(vectors: DataFrame, weights: DataFrame, key: str = "id", vector: str = "embedding", most_: float = 10.0) -> DataFrame:
    """As ``project``, with weights as rows (d, code, w) and a join on the input's place."""
    x = vectors.select(key, F.posexplode(vector).alias("d", "x"))
    s = x.join(weights, "d").groupBy(key, "code").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"))
    return s.select(key, "code", activation(F.col("s"), most_).alias("weight"))


def sparsify(terms: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k largest weights of each item that are above the index's least weight."""
    return most(terms, k, key).where(F.col("weight") > LEAST)


def query_terms(terms: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k largest query weights whose size reaches the least weight."""
    return most(terms, k, key).where(F.abs("weight") >= LEAST)


def flops(terms: DataFrame, items: int) -> DataFrame:
    """(flops): sum over outputs of the squared mean size of their weights; zeros count among the ``items``."""
    means = terms.groupBy("code").agg((F.sum(F.abs("weight")) / items).alias("m"))
    return means.agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("flops"))


def contrastive(scores: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(loss): mean cross-entropy of rows (i, j, score), where candidate j = i is query i's own.

    The largest score is taken out of the exponentials, which keeps them finite.
    """
    s = scores.withColumn("s", F.col("score") / temperature)
    top = s.groupBy("i").agg(F.max("s").alias("m"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"))
    rest = s.join(top, "i").groupBy("i").agg(F.log(F.sum(F.exp(F.col("s") - F.col("m")))).alias("l"), F.first("m").alias("m"), F.first("own").alias("own"))
    return rest.agg(F.avg(F.col("l") + F.col("m") - F.col("own")).alias("loss"))


def in_batch(queries: DataFrame, candidates: DataFrame, temperature: float = 0.05) -> DataFrame:
    """As ``contrastive``, of the scores of all queries (qid, terms) with all candidates (pid, terms), where pid = qid is the query's own.

    Scores are made in blocks and leave a task as one sum for each query.
    """

    def work(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scorer = column(block, 0), Terms(column(block, 1))
        most, rest, own = np.full(len(ids), -np.inf), np.zeros(len(ids)), np.full(len(ids), np.nan)
        for b in batches:
            for at in range(0, b.num_rows, SEARCH_ROWS):
                part = b.slice(at, SEARCH_ROWS)
                s = scorer.products(part.column(1))[0] / temperature
                top = np.maximum(most, s.max(axis=1))
                rest, most = rest * np.exp(most - top) + np.exp(s - top[:, None]).sum(axis=1), top
                place = pc.index_in(ids, value_set=part.column(0))
                mine = np.flatnonzero(np.asarray(place.is_valid()))
                own[mine] = s[mine, place.drop_null().to_numpy()]
        if np.isfinite(most).any():
            yield pa.RecordBatch.from_arrays([ids, pa.array(most), pa.array(rest), pa.array(own, from_pandas=True)], names=["i", "m", "l", "own"])

    parts = over_blocks(candidates.select("pid", "terms"), queries.select("qid", "terms"), 1, f"i {dict(queries.dtypes)['qid']}, m double, l double, own double", work)
    both = parts.groupBy("i").agg(F.max("m").alias("m"), F.collect_list(F.struct("m", "l")).alias("x"), F.max("own").alias("own"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["l"] * F.exp(x["m"] - F.col("m")))
    return both.agg(F.avg(F.log(total) + F.col("m") - F.col("own")).alias("loss"))
