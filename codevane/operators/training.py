"""Training the sparse projection with in-batch negatives, codes held by running means.

Texts become vectors once, by a frozen encoder; the table of vectors is dealt
to batches and written, and each step reads the batches it needs.  The driver
holds the model and its moments, and adds gradients as large as the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevane.functions.vectors import bucket, doubles
from codevane.operators.encode import Encoder
from codevane.operators.quantize import Quantizer, State, chunk, ema_step, matrix, nearest, revive
from codevane.operators.sparse import Projection
from codevane.sources.tables import Checkpoints, delete, scratch, write_artefact


@dataclass(frozen=True)
class Settings:
    """Flags and rates of a training run; the encoder is frozen."""

    chunks: int = 8
    outputs: int = 128
    use_quantization: bool = True
    codebook_loss: bool = True
    query_flops: bool = True
    freeze_codes: bool = False
    lambda_q: float = 0.5
    lambda_p: float = 0.5
    temperature: float = 0.05
    rate: float = 1e-4
    epochs: int = 5
    batch: int = 64
    seed: int = 0
    #: Batches whose gradients make one step; they are computed at once.
    parallel: int = 1
    warmup: int = 500
    decay: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    #: Steps between evaluations.
    every: int = 1000

    def __post_init__(self) -> None:
        if self.codebook_loss and not self.use_quantization:
            raise ValueError("a codebook loss needs quantization")


@dataclass
class Model:
    """Everything learned: the codes' state and the projection."""

    settings: Settings
    quantizer: Quantizer
    state: State
    projection: Projection
    history: list[dict[str, float]] = field(default_factory=list)
    evaluations: list[dict[str, float]] = field(default_factory=list)

    def quantized(self, x: np.ndarray) -> np.ndarray:
        """Vectors whose chunks are replaced by their codes' vectors."""
        if not self.settings.use_quantization or not len(x):
            return x
        parts = x.reshape(-1, self.quantizer.dim)
        return self.state.embed[nearest(parts, self.state.embed)].reshape(x.shape)


def losses(model: Model, q: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """The losses of a batch of queries, positives and negatives, and the gradients of weight and bias.

    Row i's own candidate is positive i; all other positives and negatives are
    its negatives.  No gradient reaches the codes.
    """
    s, pr = model.settings, model.projection
    x = [model.quantized(v) for v in (q, p, n)]
    yq, yc = pr.apply(x[0]), pr.apply(np.concatenate(x[1:]))
    logits = yq @ yc.T / s.temperature
    logits -= logits.max(axis=1, keepdims=True)
    soft = np.exp(logits)
    soft /= soft.sum(axis=1, keepdims=True)
    own = np.arange(len(q))
    ce = float(-np.log(np.maximum(soft[own, own], 1e-300)).mean())
    g = soft.copy()
    g[own, own] -= 1
    g /= len(q) * s.temperature
    dq, dc = g @ yc, g.T @ yq
    mq, mc = np.abs(yq).mean(axis=0), np.abs(yc).mean(axis=0)
    fq, fp = float((mq**2).sum()), float((mc**2).sum())
    if s.query_flops:
        dq = dq + s.lambda_q * 2 * mq / len(yq) * np.sign(yq)
    dc = dc + s.lambda_p * 2 * mc / len(yc) * np.sign(yc)
    raw = np.concatenate([q, p, n])
    code = float(((np.concatenate(x) - raw) ** 2).mean()) if s.use_quantization and len(raw) else 0.0
    total = ce + s.lambda_q * fq * s.query_flops + s.lambda_p * fp + code * s.codebook_loss
    wq, bq = pr.gradient(x[0], dq)
    wc, bc = pr.gradient(np.concatenate(x[1:]), dc)
    return {"contrastive": ce, "flops_query": fq, "flops_passage": fp, "codebook": code, "total": total}, wq + wc, bq + bc


NAMES = ("contrastive", "flops_query", "flops_passage", "codebook", "total")


def collate(triplets: DataFrame, encoder: Encoder, batch: int = 128) -> DataFrame:
    """(qid, query, positive, negatives) of vectors from the same columns of texts; ``negatives`` may be missing or null.

    The three roles of some rows go through the encoder together and are split
    again by their places.
    """
    held = triplets.sparkSession.sparkContext.broadcast(encoder)
    if "negatives" not in triplets.columns:
        triplets = triplets.withColumn("negatives", F.expr("cast(array() as array<string>)"))
    kind = dict(triplets.dtypes)["qid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                lists = [n or [] for n in b.column(3).to_pylist()]
                roles = [b.column(1).to_pylist(), b.column(2).to_pylist(), [x for n in lists for x in n]]
                v = np.asarray(model.encode([x or "" for r in roles for x in r]), float).reshape(-1, model.dim)
                q, p, n = np.split(v, np.cumsum([len(r) for r in roles])[:-1])
                ends = np.cumsum([0, *map(len, lists)])
                cols = [pa.array(q.tolist(), VECTOR), pa.array(p.tolist(), VECTOR), pa.array([n[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.list_(VECTOR))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["qid", "query", "positive", "negatives"])

    return triplets.select("qid", "query", "positive", "negatives").mapInArrow(run, f"qid {kind}, query array<double>, positive array<double>, negatives array<array<double>>")


VECTOR = pa.list_(pa.float64())


def dealt(rows: DataFrame, batches: int, seed: int) -> DataFrame:
    """Rows (batch, qid, q, p, n) of vectors, ``n`` all negatives in a row, in batches by md5; written, so that steps read their part only."""
    flat = F.flatten(F.transform(F.coalesce("negatives", F.expr("cast(array() as array<array<double>>)")), lambda v: v.cast("array<double>")))
    cols = [bucket(batches, F.lit(str(seed)), F.col("qid")).alias("batch"), "qid", doubles("query").alias("q"), doubles("positive").alias("p"), flat.alias("n")]
    spread = rows.select(*cols).repartitionByRange("batch").sortWithinPartitions("batch", "qid")
    return write_artefact(spread, scratch(rows.sparkSession))


def _gradients(rows: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """Means over the batches of rows: losses, gradients of weight and bias; and sums over them: counts and sums by code."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        m = held.value
        table = table.sort_by("qid").combine_chunks()
        q, p = (matrix(table.column(k).combine_chunks()) for k in ("q", "p"))
        n = table.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
        loss, w, b = losses(m, q, p, n)
        x = np.concatenate([q, p, n]).reshape(-1, m.quantizer.dim)
        hits, sums = np.zeros(m.quantizer.codes), np.zeros_like(m.state.embed)
        if m.settings.use_quantization and not m.settings.freeze_codes:
            near = nearest(x, m.state.embed)
            hits = np.bincount(near, minlength=m.quantizer.codes).astype(float)
            np.add.at(sums, near, x)
        parts = [np.array([loss[k] for k in NAMES]), w.ravel(), b, hits, sums.ravel()]
        return pa.table({"sums": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    # one row for each batch of the step, added as they come
    total, count = None, 0
    for r in rows.groupBy("batch").applyInArrow(run, "sums binary").toLocalIterator():
        x = np.frombuffer(r["sums"], float)
        total, count = x.copy() if total is None else total + x, count + 1
    if total is None:
        return ()
    w = model.projection.weight
    sizes = [len(NAMES), w.size, w.shape[1], model.quantizer.codes]
    loss, gw, gb, hits, sums = np.split(total, np.cumsum(sizes))
    return loss / count, gw.reshape(w.shape) / count, gb / count, hits, sums.reshape(model.state.sums.shape)


def evaluated(model: Model, rows: DataFrame) -> dict[str, float]:
    """Mean losses over the batches of ``dealt`` rows; nothing is changed."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        m = held.value
        table = table.sort_by("qid").combine_chunks()
        q, p = (matrix(table.column(k).combine_chunks()) for k in ("q", "p"))
        n = table.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
        loss, _, _ = losses(m, q, p, n)
        return pa.table({k: pa.array([loss[k]]) for k in NAMES})

    means = rows.groupBy("batch").applyInArrow(run, ", ".join(f"{k} double" for k in NAMES)).agg(*[F.avg(k).alias(k) for k in NAMES]).first()
    return {k: means[k] for k in NAMES}


def rate_at(s: Settings, step: int, steps: int) -> float:
    """The rate of a step: up to the full rate over the warm-up steps, then down to 0 at the end."""
    if step < s.warmup:
        return s.rate * step / max(1, s.warmup)
    return s.rate * max(0.0, (steps - step) / max(1, steps - s.warmup))


@dataclass
class AdamW:
    """Moments of the gradients; weights decay apart from them, biases do not."""

    settings: Settings
    moments: list[tuple[np.ndarray, np.ndarray]] | None = None
    t: int = 0

    def step(self, values: list[np.ndarray], gradients: list[np.ndarray], rate: float, decayed: list[bool]) -> list[np.ndarray]:
        s = self.settings
        self.moments = self.moments or [(np.zeros_like(v), np.zeros_like(v)) for v in values]
        self.t += 1
        out = []
        for i, (v, g) in enumerate(zip(values, gradients, strict=True)):
            m, u = self.moments[i]
            m, u = s.beta1 * m + (1 - s.beta1) * g, s.beta2 * u + (1 - s.beta2) * g * g
            self.moments[i] = (m, u)
            v = v * (1 - rate * s.decay) if decayed[i] else v
            out.append(v - rate * (m / (1 - s.beta1**self.t)) / (np.sqrt(u / (1 - s.beta2**self.t)) + s.eps))
        return out


def fit(model: Model, triplets: DataFrame, evaluation: DataFrame | None = None, checkpoints: Checkpoints | None = None) -> Model:
    """Trains on rows (qid, query, positive, negatives) of vectors, as ``collate`` makes them, and returns the model.

    A batch is the rows of one md5 bucket, a step the gradients of ``parallel``
    batches, and an epoch all batches in an order drawn by the seed.  Every
    ``every`` steps and after the last one the ``evaluation`` rows are scored
    and a checkpoint is saved; at the end the model is the one of least
    evaluation loss.  Without evaluation rows it is the last one.
    """
    s, spark = model.settings, triplets.sparkSession
    n_rows = triplets.count()
    batches = max(1, n_rows // s.batch)
    rows = dealt(triplets, batches, s.seed)
    held = dealt(evaluation, max(1, evaluation.count() // s.batch), s.seed) if evaluation is not None else None
    per_epoch = -(-batches // s.parallel)
    steps, step, best, adam = per_epoch * s.epochs, 0, None, AdamW(s)
    for epoch in range(s.epochs):
        order = np.random.default_rng((s.seed, epoch)).permutation(batches).tolist()
        for at in range(0, batches, s.parallel):
            own = rows.where(F.col("batch").isin(order[at : at + s.parallel]))
            found = _gradients(own, model)
            step += 1
            if found:
                loss, gw, gb, hits, sums = found
                rate = rate_at(s, step, steps + 1)
                p = model.projection
                model.projection = Projection(*adam.step([p.weight, p.bias], [gw, gb], rate, [True, False]), p.most)
                if s.use_quantization and not s.freeze_codes:
                    q, new = model.quantizer, ema_step(model.quantizer, model.state, hits, sums)
                    if q.reset_dead and (new.size < q.dead_below).any():
                        # in hash order over all vectors of the step's batches
                        chunks = chunk(own.select("qid", "q"), s.chunks, "q", "qid").select("v").orderBy(F.xxhash64("v"), "v").limit(q.codes)
                        new = revive(q, new, np.array([r["v"] for r in chunks.collect()]), step)
                    model.state = new
                model.history.append({"step": step, "epoch": epoch, "rate": rate} | dict(zip(NAMES, loss.tolist(), strict=True)))
            if held is not None and (step % s.every == 0 or step == steps):
                scores = evaluated(model, held)
                model.evaluations.append({"step": step} | scores)
                if checkpoints is not None:
                    checkpoints.save(step, tables(spark, model), scores["total"])
                if best is None or scores["total"] < best[0]:
                    best = (scores["total"], model.projection, model.state)
    if best is not None:
        _, model.projection, model.state = best
    for t in (rows, held):
        if t is not None:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                delete(spark, path)
    return model


def tables(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """The model as tables (name, row, values), to be written as Parquet."""
    def rows(m: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.atleast_2d(m))], "row int, values array<double>")

    return {"weight": rows(model.projection.weight), "bias": rows(model.projection.bias), "codes": rows(model.state.embed), "sizes": rows(model.state.size), "sums": rows(model.state.sums)}


def load(settings: Settings, quantizer: Quantizer, saved: dict[str, DataFrame], most: float = 10.0) -> Model:
    """The model of ``tables``; every table must be there and fit the settings."""

    def values(name: str) -> np.ndarray:
        return np.array([r["values"] for r in saved[name].orderBy("row").collect()], float)

    missing = {"weight", "bias", "codes", "sizes", "sums"} - set(saved)
    if missing:
        raise ValueError(f"no table {', '.join(sorted(missing))}")
    w, b, e, size, sums = values("weight"), values("bias")[0], values("codes"), values("sizes")[0], values("sums")
    if w.shape[1] != settings.outputs or b.shape != (settings.outputs,) or e.shape != (quantizer.codes, quantizer.dim) or sums.shape != e.shape or size.shape != (quantizer.codes,) or w.shape[0] != settings.chunks * quantizer.dim:
        raise ValueError("the saved tables do not fit the settings")
    return Model(settings, quantizer, State(e, size, sums), Projection(w, b, most))


def encoded(vectors: DataFrame, model: Model, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, code, weight): sparse representation of each vector after quantization."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if b.num_rows:
                y = m.projection.apply(m.quantized(matrix(b.column(1))))
                i, j = np.nonzero(y)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(y[i, j])], names=[key, "code", "weight"])

    return vectors.select(key, doubles(vector).alias("v")).mapInArrow(run, f"`{key}` {dict(vectors.dtypes)[key]}, code int, weight double")
