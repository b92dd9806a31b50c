"""Exact top-k by inner product with no-random-access aggregation.

Vectors are packed into blocks.  In a block, each component has a list of the
block's vectors sorted by that component; a query reads the list from the end
where its own component makes products large.  All lists are read to the same
depth, step by step.  What has been read of a vector, plus the last value read
of each component it has not shown in, bounds its score from above; with the
list's far end instead, from below.  The last values alone bound every vector
that no list has shown.  Once that bound is below the k-th best lower bound,
which a task carries on from block to block, no outsider can qualify; the
exact scores of those seen whose upper bound still reaches it are resolved.  At
the lists' end all that are left are resolved by one product.  Bounds are only
worked out where the length of the vectors does not rule out a stop anyway.

Queries are dealt to groups and blocks to rows; a task holds the queries of a
group and reads the blocks of a row one by one.  A group has at most HELD
queries, so vectors are sent once for each HELD queries, queries once for each
row, and nothing is broadcast.

Scores are exact: component x counts as floor(SCALE * x), as a whole number of
any size.  Products are taken in doubles where all sums stay below 2**53, in
64-bit numbers below 2**63, and in numbers without bound beyond that; such
vectors are kept apart, so that they do not slow down the others.

Defined results: vectors that are null or hold a null or non-finite component,
and rows without an id, take no part; a vector without components scores 0, and
shorter ones count as filled up with 0; a query never gets a row of its own id;
ties go to the smaller id; a score that 64 bits cannot hold ranks by its value
and is reported as the nearest number they can; equal vectors and repeated ids
are separate candidates, and a query id that repeats gets the best of its
vectors' results; a table without rows or queries gives none; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Vectors and queries in a block, and queries in a group.
VECTORS, QUERIES, HELD = 2048, 512, 1 << 16
#: Shares of a list's length at which bounds are looked at; at the end of the lists all is known.
DEPTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2)

LARGEST = (1 << 63) - 1
#: Sums below these are exact in doubles and in 64-bit numbers.
EXACT = ((1 << 53, np.float64), (1 << 63, np.int64))

BLOCK = "block long, dim int, ids binary, data binary"
FOUND = "query_id long, vec_id long, score long"


def _valid(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and their components as a matrix of doubles."""
    values = values.cast(pa.large_list(pa.float64()))
    there = values.is_valid().to_numpy(zero_copy_only=False)
    n = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x = values.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)] = x
    ok = there & np.isfinite(out).all(axis=1)
    return ok, out[ok]


def packed(df: DataFrame, per_block: int) -> DataFrame:
    """Rows (id, v) packed into blocks of at most ``per_block`` vectors; no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, rows, held = [], [], 0

        def out(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([x.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "dim", "ids", "data"])

        def join() -> tuple[np.ndarray, np.ndarray]:
            width = max(r.shape[1] for r in rows)
            return np.concatenate(ids), np.concatenate([_padded(r, width) for r in rows])

        for batch in batches:
            ok, x = _valid(batch.column(1))
            ids.append(batch.column(0).to_numpy(zero_copy_only=False)[ok])
            rows.append(x)
            held += len(x)
            if held >= per_block:
                a, x = join()
                full = held - held % per_block
                for i in range(0, full, per_block):
                    yield out(a[i : i + per_block], x[i : i + per_block])
                ids, rows, held = [a[full:]], [x[full:]], held - full
        if held:
            yield out(*join())

    return df.mapInArrow(pack, BLOCK)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _unpacked(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(data, np.float64).reshape(len(names), dim)


def whole(x: np.ndarray, kind: type) -> np.ndarray:
    """floor(SCALE * x) as numbers of a kind; ``object`` holds any."""
    if kind is not object:
        return np.floor(SCALE * x).astype(kind)
    # a double beyond 2**53 has no fraction
    out = [SCALE * int(v) if abs(v) > 2.0**53 else math.floor(SCALE * v) for v in x.ravel().tolist()]
    return np.array(out, object).reshape(x.shape)


def magnitudes(x: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each row: products of two rows of 0 are exact in doubles, of 1 in 64-bit numbers."""
    with np.errstate(over="ignore"):
        most = np.abs(x).max(axis=1, initial=0) * SCALE + 1
        return sum((most**2 * max(1, x.shape[1]) >= limit).astype(np.int64) for limit, _ in EXACT)


def kinds(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of a matrix by magnitude: places and rows."""
    m = magnitudes(x) if len(x) else np.zeros(0, np.int64)
    return [(at, x[at]) for k in range(3) if len(at := np.flatnonzero(m == k))]


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The numbers in which products of rows of a and b are exact."""
    most = (float(np.abs(a).max(initial=0)) * SCALE + 1) * (float(np.abs(b).max(initial=0)) * SCALE + 1) * max(1, a.shape[1])
    return next((kind for limit, kind in EXACT if most < limit), object)


def aggregate(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, bars: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """For each query its place, the ids and scores of the block's best k that reach its bar, and the share of the lists read.

    ``vectors`` and ``queries`` are whole numbers of one kind; a query's bar is
    its k-th best score so far, or None.  Queries that find nothing are left out.
    """
    n = len(vectors)
    order = np.sort(vectors, axis=0)  # a component's list, read upwards or downwards
    p, m = np.maximum(queries, 0), np.maximum(-queries, 0)
    own = ids[:, None] == query_ids[None, :]
    waiting = list(range(len(queries)))
    if vectors.dtype == object:
        reach = [math.inf] * len(queries)
    else:
        squares = [np.einsum("ij,ij->i", a, a) for a in (vectors.astype(float), queries.astype(float))]
        reach = 1.0000001 * np.sqrt(squares[0].max(initial=0.0)) * np.sqrt(squares[1])

    last = 0
    for share in DEPTHS:
        depth = math.ceil(n * share)
        if depth <= last or depth >= n or not waiting:
            continue
        last = depth
        high, low = order[n - depth], order[depth - 1]  # the last values read from the top and from the bottom
        outside = dict(zip(waiting, p[waiting] @ high - m[waiting] @ low, strict=True))  # no vector that no list has shown scores more
        # without a bar, bounds are looked at once the lengths allow that some lower bound is above the outsiders
        near = [q for q in waiting if outside[q] < (reach[q] if bars[q] is None else bars[q])]
        if not near:
            continue
        above, below = vectors >= high, vectors <= low
        pt, mt = p[near].T, m[near].T
        upper = np.where(above, vectors, high) @ pt - np.where(below, vectors, low) @ mt
        shown = above.astype(np.float32) @ (pt > 0).astype(np.float32) + below.astype(np.float32) @ (mt > 0).astype(np.float32) > 0
        shown &= ~own[:, near]
        fresh = [i for i, q in enumerate(near) if bars[q] is None]
        lower = np.where(above, vectors, order[0]) @ pt[:, fresh] - np.where(below, vectors, order[-1]) @ mt[:, fresh] if fresh else None
        bar = [bars[q] for q in near]
        for j, i in enumerate(fresh):
            seen = lower[shown[:, i], j]
            if len(seen) >= k:
                bar[i] = np.partition(seen, len(seen) - k)[len(seen) - k]
        done = [i for i, q in enumerate(near) if bar[i] is not None and outside[q] < bar[i]]
        left = shown[:, done] & reaching(upper[:, done], [bar[i] for i in done])
        for j in np.flatnonzero(left.any(axis=0)):
            q, rows = near[done[j]], np.flatnonzero(left[:, j])
            yield (q, *top(ids[rows], vectors[rows] @ queries[q], k), depth / n)
        stopped = {near[i] for i in done}
        waiting = [q for q in waiting if q not in stopped]
    if not waiting:
        return
    score = vectors @ queries[waiting].T
    hits = ~own[:, waiting]
    known = [i for i, q in enumerate(waiting) if bars[q] is not None]
    hits[:, known] &= reaching(score[:, known], [bars[waiting[i]] for i in known])
    for i in np.flatnonzero(hits.any(axis=0)):
        rows = np.flatnonzero(hits[:, i])
        yield (waiting[i], *top(ids[rows], score[rows, i], k), 1.0)


def reaching(values: np.ndarray, bars: list) -> np.ndarray:
    """Which values reach the bar of their column; bars may be beyond the values' kind."""
    if values.dtype == np.int64:
        bars = [max(-LARGEST, min(LARGEST, int(x))) for x in bars]
    return (values >= np.array(bars, values.dtype)).astype(bool)


def top(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and scores, ties to the smaller id."""
    if len(score) > 4 * k:
        rows = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        ids, score = ids[rows], score[rows]
    order = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    return ids[order], score[order]


class Best:
    """The best k of each query of a block so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def read(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in a block of vectors."""
        width = max(self.x.shape[1], vectors.shape[1])
        for rows, v in kinds(_padded(vectors, width)):
            for asked, q in kinds(_padded(self.x, width)):
                kind = exact_kind(v, q)
                bars = [-self.found[i][-1][0] if len(self.found[i]) == self.k else None for i in asked]
                for i, a, s, _ in aggregate(whole(v, kind), ids[rows], whole(q, kind), self.ids[asked], self.k, bars):
                    if len(a):
                        held = self.found[asked[i]]
                        held.extend((-int(x), int(y)) for x, y in zip(s.tolist(), a.tolist(), strict=True))
                        held.sort()
                        del held[self.k :]

    def rows(self) -> pa.RecordBatch:
        q = [int(i) for i, f in zip(self.ids, self.found, strict=True) for _ in f]
        ids = [y for f in self.found for _, y in f]
        # the place keeps the order of scores that 64 bits cannot hold
        score = [max(-LARGEST - 1, min(LARGEST, -x)) for f in self.found for x, _ in f]
        text = [str(-x) for f in self.found for x, _ in f]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array([None if -LARGEST < s < LARGEST else t for s, t in zip(score, text, strict=True)], pa.string())], names=["query_id", "vec_id", "score", "beyond"])


def search(df: DataFrame, query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """For every row where ``query`` holds, the k other rows of highest score: query_id, rank, vec_id, score."""
    rows = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), query.alias("q"))
    asked = rows.where("q").select("id", "v")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = asked.count()
    groups = max(1, -(-n // HELD))
    rooms = max(1, parts // groups)
    # queries first in each room, by their number
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups))
    left = packed(asked.repartition(groups, own), QUERIES).withColumn("group", F.shiftright("block", 32)).withColumn("room", F.explode(F.sequence(F.lit(0), F.lit(rooms - 1))))
    right = packed(rows.select("id", "v"), VECTORS).withColumn("room", F.pmod(F.xxhash64("block"), F.lit(rooms)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    columns = ["group", "room", "side", "block", "dim", "ids", "data"]
    both = left.withColumn("side", F.lit(0)).select(*columns).unionByName(right.withColumn("side", F.lit(1)).select(*columns))
    both = both.repartition(groups * rooms, "group", "room").sortWithinPartitions("group", "room", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["group"], r["room"]) != now:
                    for b in asked:
                        yield b.rows()
                    now, asked = (r["group"], r["room"]), []
                ids, x = _unpacked(r["dim"], r["ids"], r["data"])
                if r["side"] == 0:
                    asked.append(Best(ids, x, k))
                else:
                    for b in asked:
                        b.read(ids, x)
        for b in asked:
            yield b.rows()

    found = both.mapInArrow(run, FOUND + ", beyond string")
    # of scores beyond 64 bits, longer ones are further off, and of equal length the texts compare
    far = F.length("beyond") * F.signum("score")
    digits = F.when(F.col("score") > 0, F.col("beyond"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), far.desc_nulls_last(), digits.desc_nulls_last(), F.when(F.col("score") < 0, F.col("beyond")).asc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(df: DataFrame) -> DataFrame:
    return search(df, F.col("vec_id") % 100 == 0)


SQL = """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as c
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
s as (
  select q.vec_id as query_id, e.vec_id,
    cast(coalesce(list_sum([q.c[i] * e.c[i] for i in range(1, cast(least(len(q.c), len(e.c)) as bigint) + 1)]), 0) as bigint) as score
  from v as e join v as q on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id
), r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 10
"""
