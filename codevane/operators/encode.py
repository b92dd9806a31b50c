"""Encoders from text to vectors, and pooling of token vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """What a model must offer: a width, and vectors for a batch of texts."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Signed hashed bags of words of unit length; stands in where no model can be loaded."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def encode(df: DataFrame, encoder: Encoder, key: str = "id", text: str = "text", batch: int = 128) -> DataFrame:
    """(key, embedding): texts in batches through an encoder that each worker loads once."""
    held = df.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), batch):
                v = np.asarray(model.encode([t or "" for t in texts[i : i + batch]]), np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, batch), pa.array(v.tolist(), pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def mean_pool(tokens: DataFrame, key: str = "id") -> DataFrame:
    """(key, d, value): mean of token vectors (key, token, v, mask) whose mask is 1, NaN if there is none."""
    rows = tokens.select(key, "mask", F.posexplode("v").alias("d", "x"))
    kept = F.col("mask") == 1
    total = F.sum(F.when(kept, F.col("x").cast("double")).otherwise(0.0))
    n = F.sum(F.when(kept, 1).otherwise(0))
    return rows.groupBy(key, "d").agg(F.when(n > 0, total / n).otherwise(F.lit(float("nan"))).alias("value"))
