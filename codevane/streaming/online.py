"""Indexing and codebook updates as vectors arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codevane.operators import index, quantize


def append_index(stream: DataFrame, codebook: DataFrame, chunks: int, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Writes the terms of arriving (key, embedding) rows; each micro-batch is its own folder, so a retry replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        codes = quantize.assign(quantize.chunk(batch, chunks, key=key), codebook, key)
        index.term_frequency(codes, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_codebook(stream: DataFrame, quantizer: quantize.Quantizer, start: quantize.State, chunks: int, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """One update of the codes for each micro-batch; the state after batch n is the table step=n."""
    spark = stream.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        state = quantize.state(spark.read.parquet(f"{path}/step={number - 1}")) if number else start
        state = quantize.fit_macro(quantizer, state, [quantize.chunk(batch, chunks, key=key)])
        quantize.codebook(spark, state).write.mode("overwrite").parquet(f"{path}/step={number}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
