"""Readers and writers: tab-separated collections, JSON lines, Parquet artefacts and caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("train", "dev")
KINDS = ("passage", "query")

NEGATIVES = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("pos", T.ArrayType(T.LongType())),
        T.StructField("neg", T.StructType([T.StructField("bm25", T.ArrayType(T.LongType()))])),
    ]
)


def checked(mode: str, kind: str | None = None) -> None:
    """Modes and kinds are closed sets."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")


def searchable(mode: str, kind: str) -> None:
    """As ``checked``, for what a search encodes: train queries are for training only."""
    checked(mode, kind)
    if (mode, kind) == ("train", "query"):
        raise ValueError("queries of the train split are not encoded for search")


def read_tsv(spark: SparkSession, path: str, columns: int, quote: str = '"') -> DataFrame:
    """Rows of a tab-separated file without header as c0, c1, ... and ``line``, their order.

    Quoted fields may hold tabs and line ends, so a file is read by one task
    unless ``quote`` is empty, when lines are records and files are split.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    reader = spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").option("quote", quote)
    if quote:
        reader = reader.option("escape", quote).option("multiLine", True)
    return reader.csv(path).withColumn("line", F.monotonically_increasing_id())


def last_wins(df: DataFrame, key: str, value: str, order: str = "line") -> DataFrame:
    """One row for each key, with the value of its last row."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def multimap(df: DataFrame, key: str, value: str, order: str = "line") -> DataFrame:
    """One row for each key, with all its values in order, repeats included."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias(f"{value}s"))


@dataclass(frozen=True)
class Collection:
    """The five inputs of a retrieval experiment as lazily read tables."""

    passages: DataFrame
    queries: DataFrame
    qrels: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, root: str, quote: str = '"') -> Collection:
        """collection.tsv, queries.{train,dev.small}.tsv and qrels.{train,dev.small}.tsv below ``root``."""
        files = {"train": "train", "dev": "dev.small"}
        passages = last_wins(read_tsv(spark, f"{root}/collection.tsv", 2, quote).select(F.col("c0").alias("pid"), F.col("c1").alias("text"), "line"), "pid", "text")
        queries, qrels = [], []
        for mode, name in files.items():
            q = read_tsv(spark, f"{root}/queries.{name}.tsv", 2, quote).select(F.col("c0").alias("qid"), F.col("c1").alias("text"), "line")
            queries.append(last_wins(q, "qid", "text").withColumn("split", F.lit(mode)))
            r = read_tsv(spark, f"{root}/qrels.{name}.tsv", 4, quote)
            qrels.append(r.select(F.lit(mode).alias("split"), F.col("c0").alias("qid"), F.col("c2").alias("pid"), F.lit(1).alias("rel"), "line"))
        return cls(passages, queries[0].unionByName(queries[1]).select("split", "qid", "text"), qrels[0].unionByName(qrels[1]))

    def mode(self, mode: str) -> Collection:
        """The tables restricted to a mode."""
        checked(mode)
        return Collection(self.passages, self.queries.where(F.col("split") == mode), self.qrels.where(F.col("split") == mode))

    def register(self) -> None:
        """Temporary views named passages, queries and qrels."""
        for name in ("passages", "queries", "qrels"):
            getattr(self, name).createOrReplaceTempView(name)

    def samples(self, n: int = 5) -> dict[str, DataFrame]:
        """The first n rows of each table."""
        return {"passages": self.passages.orderBy("pid").limit(n), "queries": self.queries.orderBy("split", "qid").limit(n), "qrels": self.qrels.orderBy("split", "line").limit(n)}


def read_negatives(spark: SparkSession, path: str, sample_count: int | None = None) -> DataFrame:
    """JSON lines (qid, pos, neg.bm25); with ``sample_count``, one row fewer than that, as counted before the test."""
    df = spark.read.schema(NEGATIVES).json(path)
    return df if sample_count is None else df.limit(max(0, sample_count - 1))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_artefact(df: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """Writes Parquet and returns the table read back.

    The new table is written beside ``path`` and renamed when it is complete,
    so what was there stays until then, also where ``df`` reads it.
    """
    spark, fresh = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(fresh)
    fs, target = _path(spark, path)
    fs.delete(target, True)
    if not fs.rename(_path(spark, fresh)[1], target):
        raise OSError(f"cannot rename {fresh} to {path}")
    return spark.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def read_through(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written first if no finished one is there."""
    return spark.read.parquet(path) if exists(spark, path) else write_artefact(compute(), path)


class EmbeddingCache:
    """Embeddings by mode and kind below one root, each computed once: {root}/mode=.../kind=.../."""

    def __init__(self, spark: SparkSession, root: str, compute: Callable[[str, str], DataFrame]):
        self.spark, self.root, self.compute = spark, root, compute

    def path(self, mode: str, kind: str) -> str:
        checked(mode, kind)
        return f"{self.root}/mode={mode}/kind={kind}"

    def load(self, mode: str, kind: str) -> DataFrame:
        return read_through(self.spark, self.path(mode, kind), lambda: self.compute(mode, kind))

    def load_all(self, mode: str) -> dict[str, DataFrame]:
        """Both kinds of a mode; if one is missing both are computed, so that they fit together."""
        paths = {k: self.path(mode, k) for k in KINDS}
        if all(exists(self.spark, p) for p in paths.values()):
            return {k: self.spark.read.parquet(p) for k, p in paths.items()}
        return {k: write_artefact(self.compute(mode, k), p) for k, p in paths.items()}

    def dimension(self, mode: str = "dev", kind: str = "passage") -> int:
        """The width of the vectors; an error if none is there or widths differ."""
        row = shapes(self.load(mode, kind)).first()
        if row["least_width"] is None or row["least_width"] != row["greatest_width"]:
            raise ValueError("no embedding, or none of one width, to take a dimension from")
        return row["greatest_width"]


class Checkpoints:
    """Model tables by training step: the newest ``keep`` and the best, which has the least loss, the later step on a tie."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 50):
        self.spark, self.root, self.keep = spark, root, keep

    def steps(self) -> list[int]:
        fs, root = _path(self.spark, self.root)
        found = fs.listStatus(root) if fs.exists(root) else []
        names = (s.getPath().getName() for s in found)
        return sorted(int(n.removeprefix("step=")) for n in names if n.removeprefix("step=").isdigit() and exists(self.spark, f"{self.root}/{n}/metrics"))

    def save(self, step: int, tables: dict[str, DataFrame], loss: float) -> None:
        """Writes the tables, then the loss, without which a step does not count."""
        for name, df in tables.items():
            write_artefact(df, f"{self.root}/step={step}/{name}")
        write_artefact(self.spark.createDataFrame([(step, float(loss))], "step int, eval_loss double"), f"{self.root}/step={step}/metrics")
        best = self.best()
        for old in self.steps()[: -self.keep]:
            if old != best:
                delete(self.spark, f"{self.root}/step={old}")

    def load(self, step: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/step={step}/{name}")

    def best(self) -> int:
        losses = [(self.load(s, "metrics").first()["eval_loss"], -s) for s in self.steps()]
        if not losses:
            raise ValueError("no checkpoint")
        return -min(losses)[1]


def shapes(embeddings: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(items, ids, least_width, greatest_width) of a table of vectors."""
    width = F.size(vector)
    return embeddings.agg(F.count(F.lit(1)).alias("items"), F.count_distinct(key).alias("ids"), F.min(width).alias("least_width"), F.max(width).alias("greatest_width"))


def read_teacher_triples(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pos, neg) of a tab-separated file without header: two scores, then the three ids."""
    schema = "score_pos double, score_neg double, qid long, pos long, neg long"
    rows = spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").option("quote", "").csv(path)
    return rows.select("qid", F.array("pos").alias("pos"), F.array("neg").alias("neg"))


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds rows (metric, k, value, ...) to a metrics table."""
    df.write.mode("append").parquet(path)
