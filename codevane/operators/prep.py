"""Choosing passages, queries and judgements; triplets for training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codevane.functions.digests import Tails, leads
from codevane.functions.vectors import bucket
from codevane.operators.search import column, over_blocks


def judged_passages(passages: DataFrame, qrels: DataFrame, strict: bool = False) -> DataFrame:
    """Passages that some judgement names; ``strict`` fails if one names a passage that is not there."""
    wanted = qrels.select("pid").distinct()
    if strict and not missing(qrels, passages, "pid").isEmpty():
        raise ValueError("judgements name passages that are not in the collection")
    return passages.join(wanted, "pid", "left_semi")


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one judgement."""
    return queries.join(qrels.select("qid"), "qid", "left_semi")


def known_qrels(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Judgements of known queries."""
    return qrels.join(queries.select("qid"), "qid", "left_semi")


def missing(df: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(of.select(key), key, "left_anti")


def search_pool(passages: DataFrame, qrels: DataFrame, mode: str) -> DataFrame:
    """Training uses judged passages only, search the whole collection."""
    if mode not in ("train", "dev"):
        raise ValueError(f"unknown mode {mode!r}")
    return judged_passages(passages, qrels) if mode == "train" else passages


def window(df: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    """Rows start to start+limit-1 in order."""
    if start is None or start < 0 or limit < 0:
        raise ValueError("start and limit must be at least 0")
    return df.orderBy(order).offset(start).limit(limit)


def triplets(candidates: DataFrame, queries: DataFrame, passages: DataFrame, negatives: int = 2, seed: int = 42, strict: bool = True) -> DataFrame:
    """(qid, query, positive, negatives) of rows (qid, pos, neg), both arrays of ids.

    One positive and ``negatives`` negatives are drawn by the md5 of seed, query
    and id.  Ids are looked up by joins; each negative stays a text of its own.
    A drawn id without a text is an error, and so is a query without one; with
    ``strict`` off, such a negative is left out and such a positive or query
    takes its row along.  Queries without any positive have no row.
    """

    def draw(ids: str, n: int):
        keyed = F.transform(ids, lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid").cast("string"), i.cast("string"))).alias("h"), i.alias("id")))
        return F.slice(F.array_sort(keyed), 1, n)

    def drawn(role: str, n: int):
        return candidates.select("qid", F.lit(role).alias("role"), F.posexplode(draw(role, n)).alias("place", "one")).select("qid", "role", "place", F.col("one.id").alias("pid"))

    return looked_up(drawn("pos", 1).unionByName(drawn("neg", negatives)), queries, passages, strict)


def drawn_pairs(pairs: DataFrame, negatives: int = 2, seed: int = 42) -> DataFrame:
    """(qid, role, place, pid) drawn as in ``triplets`` from rows (qid, pid, role), one for each candidate.

    No list of candidates is held: Spark keeps the first rows of each window only.
    """
    keyed = pairs.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid").cast("string"), F.col("pid").cast("string"))))
    w = Window.partitionBy("qid", "role").orderBy("h", "pid")
    places = keyed.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < max(1, negatives))
    return places.where((F.col("role") == "neg") & (F.col("place") < negatives) | (F.col("role") == "pos") & (F.col("place") == 0)).select("qid", "role", "place", "pid")


#: Above all digests, for what may not be drawn.
_NEVER = 1 << 32


def drawn_by_label(queries: DataFrame, passages: DataFrame, negatives: int = 2, seed: int = 42) -> DataFrame:
    """As ``drawn_pairs``, from all passages (pid, label): those of a query's (qid, label) are positive, others negative, itself neither.

    Each pair has a digest of its own, so all of them are made, a block of
    queries and a part of the passages in a task; what leaves it are the least
    digests of each query and role.  Rows without a label are left out.
    """
    kinds = dict(queries.dtypes)["qid"], dict(passages.dtypes)["pid"]
    named = [df.where("label is not null").select(key, F.col(key).cast("string").alias("name"), "label") for df, key in ((queries, "qid"), (passages, "pid"))]

    def work(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        got = pa.Table.from_batches(parts)
        wanted = column(block, 2).unique()
        label, own, pids = pc.index_in(column(got, 2), value_set=wanted), pc.index_in(column(got, 1), value_set=column(block, 1)), column(got, 0)
        label, own = (np.asarray(x.fill_null(-1)) for x in (label, own))
        mine, names = pc.index_in(column(block, 2), value_set=wanted).to_numpy(), [x.encode() for x in column(got, 1).to_pylist()]
        groups, size = [], np.array([len(x) for x in names])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            # by label, so that a query's positives lie together
            at = at[np.argsort(label[at], kind="stable")]
            itself = np.argsort(own[at], kind="stable")
            groups.append((at, Tails([names[i] for i in at]), label[at], itself, own[at][itself]))
        query, place, role = [], [], []
        for i, name in enumerate(column(block, 1).to_pylist()):
            least: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
            for at, tails, by, itself, who in groups:
                key = leads(f"{seed}|{name}|".encode(), tails).astype(np.int64)
                key[itself[slice(*np.searchsorted(who, [i, i + 1]))]] = _NEVER
                low, high = np.searchsorted(by, [mine[i], mine[i] + 1])
                for pos, part, first in ((True, key[low:high], low), (False, key[:low], 0), (False, key[high:], high)):
                    k = 1 if pos else negatives
                    if len(part) and k:
                        edge = np.partition(part, k - 1)[k - 1] if len(part) > k else _NEVER
                        some = np.flatnonzero((part <= edge) & (part < _NEVER))
                        least[pos].append((part[some], at[first + some]))
            for pos, found in least.items():
                if found:
                    key, where = (np.concatenate(x) for x in zip(*found, strict=True))
                    k = min(len(key), 1 if pos else negatives)
                    # equal starts of digests all go on
                    keep = where[key <= np.sort(key)[k - 1]] if k else where[:0]
                    query += [i] * len(keep)
                    place += keep.tolist()
                    role += ["pos" if pos else "neg"] * len(keep)
        yield pa.RecordBatch.from_arrays([column(block, 0).take(pa.array(query, pa.int64())), pids.take(pa.array(place, pa.int64())), pa.array(role, pa.string())], names=["qid", "pid", "role"])

    return drawn_pairs(over_blocks(named[1], named[0], 1 + negatives, f"qid {kinds[0]}, pid {kinds[1]}, role string", work, 16), negatives, seed)


def looked_up(drawn: DataFrame, queries: DataFrame, passages: DataFrame, strict: bool = True) -> DataFrame:
    """(qid, query, positive, negatives) of rows (qid, role, place, pid)."""
    def found(name: str, mark: str, key: str):
        """The text, or an error where a join found none; made in the columns, so that no filter takes its place."""
        return F.when(F.col(mark).isNull(), F.raise_error(F.concat(F.lit(f"no text of {key} "), F.col(key).cast("string")))).otherwise(F.col(name)) if strict else F.col(name)

    how = "left" if strict else "inner"
    text = drawn.join(passages.select("pid", "text", F.lit(True).alias("there")), "pid", how).select("qid", "role", "place", found("text", "there", "pid").alias("text"))
    text = text.groupBy("qid").agg(
        F.max(F.when(F.col("role") == "pos", F.struct("text"))).alias("positive"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "neg", F.struct("place", "text")))).alias("negatives"),
    )
    asked = queries.select("qid", F.col("text").alias("query"), F.lit(True).alias("asked"))
    both = text.where("positive is not null").join(asked, "qid", how)
    return both.select("qid", found("query", "asked", "qid").alias("query"), F.col("positive.text").alias("positive"), F.transform("negatives", lambda x: x.text).alias("negatives"))


def split(df: DataFrame, key: str, seed: int = 42, tenths: int = 1) -> DataFrame:
    """Adds ``part``: test for ``tenths`` tenths of the keys, train for the others."""
    return df.withColumn("part", F.when(bucket(10, F.lit(str(seed)), F.col(key)) < tenths, "test").otherwise("train"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in md5 order of their keys."""
    return df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")
