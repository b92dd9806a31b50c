"""Chunks, the shared codebook, nearest codes and codebook training."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevane.functions.vectors import doubles, squared_l2

#: Largest codebook, in numbers, that is sent to every task; a larger one is joined.
SENT_VALUES = 1 << 24


def chunk(df: DataFrame, chunks: int, vector: str = "embedding", key: str = "id") -> DataFrame:
    """(key, chunk_no, v): the vector cut into equal parts, in order.

    A length that ``chunks`` does not divide is an error when rows are read.
    """
    if chunks < 1:
        raise ValueError("chunks must be positive")
    fits = F.assert_true(F.size(vector) % chunks == 0, F.lit(f"vector length must be a multiple of {chunks}"))
    width = (F.size(vector) / chunks).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda j: F.slice(doubles(vector), (j * width + 1).cast("int"), width))
    return df.where(fits.isNull()).select(key, F.posexplode(parts).alias("chunk_no", "v"))


def unchunk(chunks: DataFrame, key: str = "id") -> DataFrame:
    """(key, embedding): chunks put together in their order."""
    return chunks.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "v"))), lambda c: c.v)).alias("embedding"))


def assign_sql(chunks: DataFrame, codebook: DataFrame, key: str = "id") -> DataFrame:
    """(key, chunk_no, code): the nearest code of each chunk, the least code on a tie, by a join on all codes; for small tables."""
    pairs = chunks.crossJoin(codebook.select("code", F.col("v").alias("e")))
    dist = squared_l2(F.col("v"), F.col("e"))
    return pairs.groupBy(key, "chunk_no").agg(F.min_by("code", F.struct(dist, "code")).alias("code"))


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the nearest codes, by squared distance in doubles, in blocks of bounded size."""
    out = np.empty(len(x), np.int64)
    step = max(1, (1 << 22) // max(1, codes.shape[0]))
    norms = (codes * codes).sum(axis=1)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d = norms - 2 * (part @ codes.T)
        best = d.argmin(axis=1)
        # near ties are decided by the differences themselves
        close = d <= d.min(axis=1, keepdims=True) + 1e-9
        for r in np.flatnonzero(close.sum(axis=1) > 1):
            c = np.flatnonzero(close[r])
            best[r] = c[((part[r] - codes[c]) ** 2).sum(axis=1).argmin()]
        out[i : i + step] = best
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codes(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = codebook.select("code", doubles("v").alias("v")).orderBy("code").toArrow().combine_chunks()
    column = rows.column(1).combine_chunks() if isinstance(rows.column(1), pa.ChunkedArray) else rows.column(1)
    return rows.column(0).to_numpy(), matrix(column)


def assign(chunks: DataFrame, codebook: DataFrame, key: str = "id") -> DataFrame:
    """As ``assign_sql``, by matrix products over Arrow batches.

    A codebook of up to SENT_VALUES numbers is sent to every task.  A larger one
    is cut into parts of that size by its codes; each part gives every chunk its
    nearest code and distance, and the least of these is kept.
    """
    size = codebook.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
    if not size:
        raise ValueError("the codebook is empty")
    kind = dict(chunks.dtypes)[key]
    parts = -(-size // SENT_VALUES)
    out = None
    for part in range(parts):
        some = codebook if parts == 1 else codebook.where(F.pmod(F.xxhash64("code"), F.lit(parts)) == part)
        found = _codes(some)
        if not len(found[0]):
            continue
        held = chunks.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, e = held.value
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(2))
                    near = nearest(x, e)
                    dist = ((x - e[near]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[near].astype(np.int32)), pa.array(dist)], names=[key, "chunk_no", "code", "dist"])

        got = chunks.select(key, "chunk_no", "v").mapInArrow(run, f"`{key}` {kind}, chunk_no int, code int, dist double")
        out = got if out is None else out.unionByName(got)
    if parts == 1:
        return out.drop("dist")
    return out.groupBy(key, "chunk_no").agg(F.min_by("code", F.struct("dist", "code")).alias("code"))


def dequantize(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """codes with ``q``, the vector of each code."""
    return codes.join(codebook.select("code", F.col("v").alias("q")), "code")


def quantization_loss(chunks: DataFrame, codes: DataFrame, codebook: DataFrame, key: str = "id") -> DataFrame:
    """(code, n, loss): chunks of each code and the mean squared error over their components."""
    both = chunks.join(dequantize(codes, codebook), [key, "chunk_no"])
    error = squared_l2(F.col("v"), F.col("q"))
    return both.groupBy("code").agg(F.count(F.lit(1)).alias("n"), (F.sum(error) / F.sum(F.size("v"))).alias("loss"))


@dataclass(frozen=True)
class Quantizer:
    """Settings of codebook training.

    ``initial_size`` is 0 for the plain form and 1 for the form with
    ``reset_dead``, which gives codes below ``dead_below`` a row of the batch.
    """

    codes: int
    dim: int
    decay: float = 0.99
    eps: float = 1e-5
    initial_size: float = 0.0
    reset_dead: bool = False
    dead_below: float = 0.1
    seed: int = 0

    def initial(self) -> State:
        e = np.random.default_rng(self.seed).standard_normal((self.codes, self.dim))
        return State(e, np.full(self.codes, float(self.initial_size)), e.copy())

    def started(self, vectors: np.ndarray) -> State:
        """A state whose codes are given vectors, as after k-means."""
        e = np.asarray(vectors, float)
        return State(e, np.full(len(e), float(self.initial_size)), e.copy())


@dataclass(frozen=True)
class State:
    """Vectors of the codes, their sizes and their running sums."""

    embed: np.ndarray
    size: np.ndarray
    sums: np.ndarray


def ema_step(q: Quantizer, s: State, counts: np.ndarray, sums: np.ndarray) -> State:
    """One update from a batch's counts and sums by code, which were assigned with the codes of ``s``."""
    size = q.decay * s.size + (1 - q.decay) * counts
    total = q.decay * s.sums + (1 - q.decay) * sums
    n = size.sum()
    smooth = (size + q.eps) / (n + len(size) * q.eps) * n
    with np.errstate(divide="ignore", invalid="ignore"):
        return State(total / smooth[:, None], size, total)


def revive(q: Quantizer, s: State, rows: np.ndarray, step: int) -> State:
    """Dead codes take batch rows, drawn with repeats by seed and step."""
    dead = np.flatnonzero(s.size < q.dead_below)
    if not q.reset_dead or not len(dead) or not len(rows):
        return s
    new = rows[np.random.default_rng((q.seed, step)).integers(0, len(rows), len(dead))]
    embed, size, sums = s.embed.copy(), s.size.copy(), s.sums.copy()
    embed[dead], size[dead], sums[dead] = new, 1.0, new
    return State(embed, size, sums)


def batch_stats(chunks: DataFrame, codes: np.ndarray, sample: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums by code of all chunks, and some rows; tasks send one row for each code they meet."""
    held = chunks.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = held.value
        n, sums = np.zeros(len(e), np.int64), np.zeros(e.shape)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                near = nearest(x, e)
                n += np.bincount(near, minlength=len(e))
                for d in range(x.shape[1]):
                    sums[:, d] += np.bincount(near, x[:, d], minlength=len(e))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[hit]), pa.array([sums[i].tolist() for i in hit], pa.list_(pa.float64()))], names=["code", "n", "s"])

    parts = chunks.select("v").mapInArrow(run, "code int, n long, s array<double>")
    dims = parts.select("code", "n", F.posexplode("s").alias("d", "x")).groupBy("code", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    n, sums = np.zeros(len(codes)), np.zeros(codes.shape)
    for r in dims.toLocalIterator():
        n[r["code"]] = r["n"]
        sums[r["code"], r["d"]] = r["x"]
    # drawn from all chunks in hash order, so that they do not come from one corner of sorted data
    drawn = chunks.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect() if sample else []
    return n, sums, np.array([r["v"] for r in drawn]).reshape(-1, codes.shape[1])


def fit_exact(q: Quantizer, s: State, chunks: DataFrame, order: list[str], batch: int = 512) -> State:
    """One pass over ordered chunks in batches, each assigned with the codes the last one left.

    Batch order is part of the result, so one task runs through the sorted
    rows; use ``fit_macro`` where that is too slow.
    """
    # repartition, so that only the ordered pass is one task and not the scan below it
    ordered = chunks.select(*order, "v").repartition(1).sortWithinPartitions(*order)
    at = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rest, step = s, np.zeros((0, q.dim)), 0

        def update(state: State, x: np.ndarray, step: int) -> State:
            near = nearest(x, state.embed)
            n = np.bincount(near, minlength=q.codes).astype(float)
            sums = np.zeros_like(state.embed)
            np.add.at(sums, near, x)
            return revive(q, ema_step(q, state, n, sums), x, step)

        for b in batches:
            rest = np.concatenate([rest, matrix(b.column(at))]) if b.num_rows else rest
            while len(rest) >= batch:
                state, rest, step = update(state, rest[:batch], step), rest[batch:], step + 1
        if len(rest):
            state = update(state, rest, step)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(q.codes, dtype=np.int32)), pa.array(state.embed.tolist(), pa.list_(pa.float64())), pa.array(state.size), pa.array(state.sums.tolist(), pa.list_(pa.float64()))], names=["code", "v", "cluster_size", "embed_avg"])

    rows = ordered.mapInArrow(run, "code int, v array<double>, cluster_size double, embed_avg array<double>").orderBy("code").collect()
    return State(np.array([r["v"] for r in rows]), np.array([r["cluster_size"] for r in rows]), np.array([r["embed_avg"] for r in rows]))


def fit_macro(q: Quantizer, s: State, batches: list[DataFrame]) -> State:
    """Each table is one batch and one distributed aggregate; only sums by code reach the driver."""
    for step, df in enumerate(batches):
        n, sums, rows = batch_stats(df, s.embed, q.codes if q.reset_dead else 0)
        s = revive(q, ema_step(q, s, n, sums), rows, step)
    return s


def codebook(spark: SparkSession, s: State) -> DataFrame:
    """(code, v, cluster_size, embed_avg)."""
    rows = [(i, s.embed[i].tolist(), float(s.size[i]), s.sums[i].tolist()) for i in range(len(s.size))]
    return spark.createDataFrame(rows, "code int, v array<double>, cluster_size double, embed_avg array<double>")


def state(book: DataFrame) -> State:
    """The state of a codebook table (code, v and, where they are known, cluster_size and embed_avg); codes run from 0 without gaps."""
    names = [c for c in ("code", "v", "cluster_size", "embed_avg") if c in book.columns]
    rows = book.select(*names).orderBy("code").collect()
    if not rows or [r["code"] for r in rows] != list(range(len(rows))):
        raise ValueError("a codebook needs the codes from 0 without gaps")
    e = np.array([r["v"] for r in rows], float)
    size = np.array([r["cluster_size"] for r in rows], float) if "cluster_size" in names else np.zeros(len(rows))
    return State(e, size, np.array([r["embed_avg"] for r in rows], float) if "embed_avg" in names else e.copy())


def ema_sql(chunks: DataFrame, codes: DataFrame, book: DataFrame, decay: float = 0.99, eps: float = 1e-5, key: str = "id") -> DataFrame:
    """One update as DataFrame operations: (code, d, size, total, value) from rows (code, cluster_size, embed_avg) and assigned chunks.

    ``total`` is the new embed_avg, ``value`` the new vector.
    """
    hits = chunks.join(codes, [key, "chunk_no"]).select("code", F.posexplode("v").alias("d", "x"))
    stats = hits.groupBy("code", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    old = book.select("code", "cluster_size", F.posexplode("embed_avg").alias("d", "y"))
    new = old.join(stats, ["code", "d"], "left").select(
        "code",
        "d",
        (F.col("cluster_size") * decay + F.coalesce("n", F.lit(0)) * (1 - decay)).alias("size"),
        (F.col("y") * decay + F.coalesce("s", F.lit(0.0)) * (1 - decay)).alias("total"),
    )
    whole = new.where("d = 0").agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("k"))
    smooth = (F.col("size") + eps) / (F.col("all") + F.col("k") * eps) * F.col("all")
    return new.crossJoin(F.broadcast(whole)).select("code", "d", "size", "total", (F.col("total") / smooth).alias("value"))
