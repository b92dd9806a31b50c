"""Shards that each mirror the mixture: proportional stratified interleaving.

Rows of a source are put in a seeded random order; a row's fractional rank is
its place there over the source's count.  Sorting all rows by fractional rank
spreads every source evenly, so equal cuts of that order hold each source in
its share.  The law is ``rows``: shard counts differ by one at most.

No window spans a whole source or the whole table.  A rank is a rank within a
cell (a slice of the hash, or of the fractional rank) plus the cell's offset;
offsets are running sums over one small row for each cell, taken within spans
of SPAN cells and then over the spans, so that no task reads all cells.  Cells
follow the number of rows, so a source with a third of all rows is cut like any
other.  Ranks are whole numbers and hold up to 2**47 rows of a source.

Defined results: a null text has no bytes (size 1, checksum 0); a null source
is a source of its own; repeated rows each get a place, and which of two equal
rows comes first is immaterial; a table without rows gives none; columns not
named here pass through ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = "__shard_"
#: Rows a cell holds on average.
CELL_ROWS = 4096
#: Cells of a span.
SPAN = 4096


def fraction(rank: Column, total: Column) -> Column:
    """(rank + 1/2) / total in units of 2**-30, rounded down, in whole numbers; total is below 2**47."""
    odd, all_ = 2 * rank + 1, 2 * total

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    scaled = odd * F.lit(1 << 15)
    return div(scaled, all_) * F.lit(1 << 15) + div((scaled % all_) * F.lit(1 << 15), all_)


def offsets(df: DataFrame, group: list[str], cell: str, amount: Column | None = None) -> DataFrame:
    """For each group and cell: the rows, or the sum of ``amount``, in earlier cells of the group (before) and in the whole group (total).

    Sums are over one row for each cell, never one for each document; groups
    may be null.
    """
    counts = df.groupBy(*group, cell).agg(F.sum(F.lit(1) if amount is None else amount).alias(P + "n")).withColumn(P + "span", F.floor(F.col(cell) / SPAN))
    names = [F.col(g).alias(P + "s_" + g) for g in group]
    spans = counts.groupBy(*group, P + "span").agg(F.sum(P + "n").alias(P + "all"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = F.sum(P + "all").over(w.orderBy(P + "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(P + "all")
    spans = spans.select(*names, F.col(P + "span").alias(P + "s_span"), earlier.alias(P + "earlier"), F.sum(P + "all").over(w).alias(P + "total"))
    on = F.col(P + "span") == F.col(P + "s_span")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(P + "s_" + g))
    own = Window.partitionBy(*group, P + "span").orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(P + "n").over(own) - F.col(P + "n")
    counts = counts.withColumn(P + "local", before).join(spans, on)
    return counts.select(*group, cell, (F.col(P + "local") + F.col(P + "earlier")).alias(P + "before"), P + "total")


def _ranked(df: DataFrame, group: list[str], cell: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, the rank from 0 within the group, and the group's size as ``total``."""
    local = F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)) - 1
    earlier = offsets(df, group, cell).select(*[F.col(g).alias(P + "o_" + g) for g in group], F.col(cell).alias(P + "o_cell"), P + "before", P + "total")
    on = F.col(cell) == F.col(P + "o_cell")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(P + "o_" + g))
    ranked = df.withColumn(P + "local", local).join(earlier, on)
    return ranked.withColumn(out, (F.col(P + "local") + F.col(P + "before")).cast("long")).drop(P + "local", P + "before", P + "o_cell", *[P + "o_" + g for g in group])


def assign(df: DataFrame, shards: int = 8, seed: int = 17, source: str = "source", keys: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Adds ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard) to every row.

    ``keys`` seed the shuffle and break its ties; rows alike in all of them
    and in the source can change places.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.count()
    cells = max(1, -(-rows // CELL_ROWS))
    src = P + "source"
    mixed = F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys], F.col(f"`{source}`"))
    df = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source}`").alias(src), mixed.alias(P + "h"), F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(~seed)).alias(P + "t"))
    top = F.shiftrightunsigned(F.col(P + "h"), 34)
    # ordered as an unsigned number, so that the slices of the hash are in order
    df = df.withColumn(P + "cell", F.call_function("div", top * cells, F.lit(1 << 30))).withColumn(P + "u", F.shiftrightunsigned(F.col(P + "h"), 1))
    df = _ranked(df, [src], P + "cell", [F.col(P + "u"), F.col(P + "t")], P + "rank").drop(P + "cell")
    df = df.withColumn(P + "frac", fraction(F.col(P + "rank"), F.col(P + "total"))).drop(P + "total")
    df = df.withColumn(P + "cell", F.call_function("div", F.col(P + "frac") * cells, F.lit(1 << 30)))
    df = _ranked(df, [], P + "cell", [F.col(P + "frac"), F.xxhash64(F.lit(seed), src), F.col(src), F.col(P + "rank")], P + "place")
    # shard s holds places ceil(s * rows / shards) up to the next such bound
    shard = F.call_function("div", F.col(P + "place") * shards, F.col(P + "total")).cast("int")
    first = F.call_function("div", F.col("shard") * F.col(P + "total") + (shards - 1), F.lit(shards))
    df = df.withColumn("shard", shard).withColumn("slot", F.col(P + "place") - first)
    return df.select(*[F.col(f"`{c}`") for c in names], "shard", "slot")


def write(df: DataFrame, path: str, shards: int = 8, seed: int = 17) -> None:
    """Writes each shard as a folder of Parquet files, ordered by slot within a file."""
    assign(df, shards, seed).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(df: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, checksum, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = df.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    placed = assign(small, shards, keys=("doc_id", "text_hash", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
