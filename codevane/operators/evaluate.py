"""From embeddings to metrics in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codevane.operators import index, metrics, quantize, search
from codevane.sources.tables import EmbeddingCache, searchable


def codes_of(cache: EmbeddingCache, codebook: DataFrame, chunks: int, mode: str = "dev", kind: str = "passage") -> DataFrame:
    """(id, chunk_no, code) of cached embeddings; queries of the train split are refused."""
    searchable(mode, kind)
    return quantize.assign(quantize.chunk(cache.load(mode, kind), chunks), codebook)


def run_of(method: str, passages: DataFrame, queries: DataFrame, k: int = 1000, codebook: DataFrame | None = None, chunks: int = 8, weighting: str = "tf", pad: bool = False, own: bool = True) -> DataFrame:
    """(qid, pid, score, rank) of (pid, embedding) and (qid, embedding): ``dense`` by inner products, ``vq`` by codes.

    ``weighting`` is that of query codes; ``pad`` fills results up to k with
    passages of score 0; ``own`` off leaves a query out of its own results.
    """
    if method == "dense":
        return search.dense_search(passages, queries, k, own)
    if method != "vq":
        raise ValueError("method must be dense or vq")
    if codebook is None:
        raise ValueError("vq needs a codebook")
    sides = {}
    for df, key, how in ((passages, "pid", "tf"), (queries, "qid", weighting)):
        codes = quantize.assign(quantize.chunk(df, chunks, key=key), codebook, key)
        sides[key] = index.term_frequency(codes, key, how)
    return search.sparse_search(sides["qid"], sides["pid"], k, passages if pad else None, own=own)


def evaluate(method: str, passages: DataFrame, queries: DataFrame, qrels: DataFrame | None, ks: tuple[int, ...] = (10, 100, 1000), **options) -> DataFrame:
    """(metric, k, value) of a method over embeddings; further options as in ``run_of``.

    Without ``qrels`` the passages with a query's label are its judgements.
    """
    run = run_of(method, passages, queries, max(ks), **options)
    if qrels is not None:
        return metrics.evaluate(run, qrels, ks)
    return metrics.means(metrics.per_labelled_query(run, queries, passages, ks, own=options.get("own", True)))
