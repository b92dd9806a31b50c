"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's target says how many of its words the mix takes: whole passes over
the source, then a part of one more.  The documents of a source stand in a
seeded random order, which is cut into blocks of about equal words; a pass
takes all blocks, the part takes the first ones.  A binary tree over the output
shards splits the block quotas of all sources: each node draws its left half's
blocks without replacement, so every leaf's quotas are exact and together they
use each block once.  Leaves take disjoint runs of blocks, and a shard is then
shuffled by a hash of its rows.

Places in the random order are running sums inside cells (slices of the hash)
plus the cell's offset, so no task holds a whole source.  Sources are rows of a
table, too: their number is not bounded by the driver.  The level up to which
all sources share alike is narrowed down by sums over a few thousand bins.  The
tree first splits the quotas of groups of GROUP sources, then each group's part
among its sources, in a task of its own; the draws are those of one tree, since
a draw without replacement can be made for a group first and for its members
then.  The driver holds a row for each group.

Documents larger than 1/64 of their source come first in its order, so that
the place where a part ends lies among small ones and targets are met closely.

Defined results: a null text has no words and is taken as often as its source
has whole passes; a null source is a source of its own, last in order; a source
without words has target 0; repeated rows are separate documents; a table
without rows gives none; columns not named here pass through ``plan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codevane.llm import sharding, store

P = "__mix_"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
CELL_ROWS = 4096
#: Blocks in a shard.
BLOCKS = 1024
LARGE = 64
UNITS = 1 << 14
#: Sources of a group, and bins in which the level is looked for.
GROUP, BINS = 4096, 4096


def size(text: Column) -> Column:
    """Words of a text; a word is a run without space and the controls 9 to 13."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def ordered(sizes: DataFrame) -> DataFrame:
    """Adds ``rank``, a source's place from 0 by code point, null last; written, so that it stays what it is."""
    key = F.col("source").asc_nulls_last()
    df = sizes.repartitionByRange(key).sortWithinPartitions(key)
    df = store.written(df.withColumn(P + "id", F.monotonically_increasing_id()))
    # a partition's rows are numbered from its number times 2**33
    df = df.withColumn(P + "part", F.shiftright(P + "id", 33))
    counts = df.groupBy(P + "part").agg(F.count(F.lit(1)).alias(P + "n"))
    w = Window.partitionBy(F.lit(0)).orderBy(P + "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(P + "part", (F.sum(P + "n").over(w) - F.col(P + "n")).alias(P + "first"))
    rank = F.col(P + "first") + F.col(P + "id").bitwiseAND(F.lit((1 << 33) - 1))
    return df.join(F.broadcast(counts), P + "part").withColumn("rank", rank).drop(P + "part", P + "id", P + "first")


def level(df: DataFrame, budget: float) -> float:
    """The level x at which the sums of min(w * x, cap) over rows (w, cap, full = cap / w) are the budget.

    Of the places ``full`` where a row stops growing, the first where the sums
    reach the budget is narrowed down to one value.
    """
    below, above, part = 0.0, 0.0, df
    edges = df.agg(F.min("full"), F.max("full")).first()
    while True:
        lo, hi = edges
        at = F.lit(0) if lo == hi else F.least(F.floor((F.col("full") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = sorted(part.groupBy(at.alias("bin")).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.min("full").alias("lo"), F.max("full").alias("hi")).collect())
        rest = above + sum(b["w"] for b in bins)
        for b in bins:
            rest -= b["w"]
            if below + b["cap"] + b["hi"] * rest >= budget or b is bins[-1]:
                break
            below += b["cap"]
        if b["lo"] == b["hi"]:
            return (budget - below) / (b["w"] + rest)
        above, edges = rest, (b["lo"], b["hi"])
        part = df.where(F.col("full").between(*edges))


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size) with ``rank`` and ``target``: shares by weight, none above MOST of its source."""
    df = ordered(sizes)
    total = df.agg(F.sum("source_size")).first()[0]
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    df = df.withColumn("w", weight).withColumn("cap", F.lit(MOST) * F.col("source_size")).withColumn("full", F.col("cap") / F.col("w"))
    x = 0.0 if not total else level(df, SHARE * total)
    return df.withColumn("target", F.least(F.col("w") * x, F.col("cap"))).drop("w", "cap", "full")


def split(quotas: np.ndarray, shares: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] blocks dealt to shards that take shares[shard] of them: out[shard, source], exact in both sums.

    The tree over the shards; each node draws its left half's blocks without
    replacement, source by source.
    """
    if len(shares) == 1:
        return quotas[None, :]
    left = len(shares) // 2
    taken, over, want = np.zeros_like(quotas), int(quotas.sum()), int(shares[:left].sum())
    for i, q in enumerate(quotas):
        over -= int(q)
        taken[i] = want if over == 0 else rng.hypergeometric(int(q), over, want) if want and q else 0
        want -= int(taken[i])
    return np.concatenate([split(taken, shares[:left], rng), split(quotas - taken, shares[left:], rng)])


def even(blocks: int, shards: int) -> np.ndarray:
    """How many of the blocks each shard takes, one more or less."""
    return np.diff(np.arange(shards + 1) * blocks // shards)


def _bounds(parts: DataFrame, shards: int, seed: int, width: int) -> DataFrame:
    """parts (rank, words) with ``bounds``: the first block of each shard but the first, of every source."""
    blocks = F.ceil(F.col("words") / width).cast("long")
    parts = parts.withColumn("quota", blocks).withColumn("group", F.floor(F.col("rank") / GROUP))
    groups = sorted(parts.groupBy("group").agg(F.sum("quota").alias("quota")).collect())
    sums = np.array([g["quota"] for g in groups], np.int64)
    dealt = split(sums, even(int(sums.sum()), shards), np.random.Generator(np.random.PCG64(seed)))
    held = {g["group"]: dealt[:, i].tolist() for i, g in enumerate(groups)}
    shares = parts.sparkSession.createDataFrame(list(held.items()), "group long, shares array<long>")

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        quotas, own = table.column("quota").to_numpy(), np.array(table.column("shares")[0].as_py(), np.int64)
        rng = np.random.Generator(np.random.PCG64([seed, table.column("group")[0].as_py()]))
        bounds = np.cumsum(split(quotas, own, rng), axis=0)[:-1].T
        return pa.table({"rank": table.column("rank"), "bounds": pa.array(bounds.tolist(), pa.list_(pa.int64()))})

    found = parts.join(shares, "group").select("group", "rank", "quota", "shares").groupBy("group").applyInArrow(deal, "rank long, bounds array<long>")
    return parts.drop("quota", "group").join(found, "rank")


def _placed(df: DataFrame, cells: int) -> DataFrame:
    """Adds ``at``, the words before the row in its source's and stratum's order."""
    group = [P + "source", P + "large", P + "cell"]
    top = F.shiftrightunsigned(F.col(P + "h"), 40)
    df = df.withColumn(P + "cell", F.floor(top * cells / F.lit(1 << 24)).cast("long"))
    local = F.sum(P + "size").over(Window.partitionBy(*group).orderBy(F.shiftrightunsigned(F.col(P + "h"), 1), P + "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(P + "size")
    sums = sharding.offsets(df, group[:2], group[2], F.col(P + "size"))
    sums = sums.select(*[F.col(g).alias(g + "_o") for g in group], F.col(sharding.P + "before").alias(P + "before"))
    on = F.col(group[0]).eqNullSafe(F.col(group[0] + "_o")) & (F.col(group[1]) == F.col(group[1] + "_o")) & (F.col(group[2]) == F.col(group[2] + "_o"))
    df = df.withColumn(P + "local", local).join(sums, on)
    return df.withColumn(P + "at", F.col(P + "local") + F.col(P + "before")).drop(P + "local", P + "before", P + "cell", *[g + "_o" for g in group])


def _fitting(docs: list[tuple[int, int]], part: float, small: int) -> tuple[list[int], int]:
    """Which of a source's large documents (place, size), fewer than LARGE, the part takes, and their words.

    Of all sums that some of them reach, in units of 1/UNITS of their words,
    the one is taken that the ``small`` words of the other documents can best
    fill up to the part, and of such sums the nearest to their own share.
    """
    total = sum(n for _, n in docs)
    unit = max(1, total // UNITS)
    reach = [1]
    for _, n in docs:
        reach.append(reach[-1] | reach[-1] << round(n / unit))
    quota = part * total / (total + small)
    sums = (i for i, bit in enumerate(reversed(bin(reach[-1])[2:])) if bit == "1")
    best = min(sums, key=lambda i: (max(part - small - i * unit, i * unit - part, 0), abs(i * unit - quota)))
    out, got = [], 0
    for k in range(len(docs), 0, -1):
        at, n = docs[k - 1]
        if not reach[k - 1] >> best & 1:
            best -= round(n / unit)
            out.append(at)
            got += n
    return out, got


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each source: words of its large documents, which of them the part takes, words of the part left to the others, and words in all."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            docs = sorted((d[P + "at"], d[P + "size"]) for d in r["docs"] or [])
            total = sum(n for _, n in docs)
            spots, got = _fitting(docs, r["part"], r["source_size"] - total) if docs else ([], 0)
            rest = min(max(r["part"] - got, 0.0), float(r["source_size"] - total))
            out.append((r["rank"], total, spots, rest, r["passes"] * r["source_size"] + int(round(got + rest))))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["rank", "large", "spots", "rest", "words"])


def plan(df: DataFrame, shards: int = 16, seed: int = 29, source: str = "source", keys: tuple[str, ...] = ("doc_id", "text"), words: str | None = None) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``taken`` and ``shards``: the shard of each copy.

    ``words`` names a column that has the size already.  A document's copies
    are the entries of ``shards``; it may have none.
    """
    added = ("size", "source_size", "target", "taken", "shards")
    names = [c for c in df.columns if c not in added]
    hashed = [F.col(f"`{k}`") for k in keys]
    n = F.col(f"`{words}`") if words else size(F.col("text"))
    df = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source}`").alias(P + "source"), n.alias(P + "size"), F.xxhash64(F.lit(seed), *hashed).alias(P + "h"), F.xxhash64(*hashed, F.lit(~seed)).alias(P + "t"))
    # read several times from here on, so words are counted once and kept
    df = store.written(df)
    sizes = store.written(df.groupBy(F.col(P + "source").alias("source")).agg(F.sum(P + "size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    rows = sizes.agg(F.sum("rows")).first()[0]
    empty = F.expr("cast(array() as array<int>)")
    if not rows:
        return df.select(*[F.col(f"`{c}`") for c in names], F.col(P + "size").alias("size"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), empty.alias("shards"))
    cells = max(1, -(-rows // CELL_ROWS))

    def with_table(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        """Adds columns of a written table of one row for each source; Spark broadcasts it if it is small."""
        small = table.select(F.col("source").alias(P + "key"), *columns)
        return df.join(small, F.col(P + "source").eqNullSafe(F.col(P + "key"))).drop(P + "key")

    size_of, target_of = F.col("source_size"), F.col("target")
    passes = F.when(size_of > 0, F.floor(target_of / size_of)).otherwise(0).cast("int")
    facts = store.written(targets(sizes).withColumn(P + "passes", passes).withColumn(P + "part", target_of - F.col(P + "passes") * size_of))
    df = with_table(df, facts, "source_size", "target", P + "passes", P + "part")
    df = df.withColumn(P + "large", F.col(P + "size") * LARGE > F.col("source_size"))
    # large documents are few and in an order of their own, which is made without the others
    large = _placed(df.where(P + "large").select(*[P + c for c in ("source", "size", "h", "t", "large")]), cells)
    df = _placed(df, cells)
    # the large documents' share of the part, by whole documents; the small ones make up for what that misses
    large = large.groupBy(F.col(P + "source").alias("source")).agg(F.collect_list(F.struct(P + "at", P + "size")).alias("docs"))
    both = facts.join(large.withColumnRenamed("source", P + "s"), F.col("source").eqNullSafe(F.col(P + "s")), "left").select("rank", "source_size", F.col(P + "passes").alias("passes"), F.col(P + "part").alias("part"), "docs")
    parts = store.written(both.mapInArrow(store.frugal(_parts), "rank long, large long, spots array<long>, rest double, words long"))
    width = max(1, parts.agg(F.sum("words")).first()[0] // (shards * BLOCKS))
    dealt = store.written(facts.select("source", "rank").join(_bounds(parts, shards, seed, width), "rank"))
    renamed = dealt.select("source", F.col("large").alias(P + "offset"), F.col("spots").alias(P + "spots"), F.col("rest").alias(P + "rest"), F.col("bounds").alias(P + "bounds"))
    df = with_table(df, renamed, P + "offset", P + "spots", P + "rest", P + "bounds").withColumn(P + "width", F.lit(width))
    first = F.col(P + "at") + F.col(P + "size") / 2 <= F.col(P + "rest")
    extra = (F.col(P + "size") > 0) & F.when(F.col(P + "large"), F.array_contains(P + "spots", F.col(P + "at"))).otherwise(first)
    copies = F.col(P + "passes") + extra.cast("int")
    place = F.col(P + "at") + F.when(F.col(P + "large"), 0).otherwise(F.col(P + "offset"))

    def shard(c: Column) -> Column:
        """The leaf whose run of blocks holds the c-th copy."""
        block = F.floor((c * F.col("source_size") + place) / F.col(P + "width"))
        return F.size(F.filter(P + "bounds", lambda b: b <= block))

    where = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), shard)).otherwise(empty)
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(P + "size").alias("size"), "source_size", "target", (F.col(P + "size") * copies).alias("taken"), where.alias("shards"))


def mixed(df: DataFrame, shards: int = 16, seed: int = 29, keys: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The mix itself: each copy of each taken document with its ``shard`` and its ``slot_key``, a random order in the shard."""
    names = [c for c in df.columns if c not in ("shard", "slot_key")]
    rows = plan(df, shards, seed, keys=keys).select(*[F.col(f"`{c}`") for c in names], F.posexplode("shards").alias(P + "copy", "shard"))
    return rows.withColumn("slot_key", F.xxhash64(F.lit(seed), P + "copy", *[F.col(f"`{k}`") for k in keys])).drop(P + "copy")


def write(df: DataFrame, path: str, shards: int = 16, seed: int = 29) -> None:
    """Writes the mix, a folder for each shard, every file in shuffled order."""
    mixed(df, shards, seed).repartition("shard", F.pmod("slot_key", F.lit(64))).sortWithinPartitions("shard", "slot_key").drop("slot_key").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards of its copies."""
    small = docs.select("doc_id", "source", size(F.col("text")).alias(P + "words"), F.xxhash64("text").alias(P + "text"))
    return plan(small, keys=("doc_id", P + "text"), words=P + "words").select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))
