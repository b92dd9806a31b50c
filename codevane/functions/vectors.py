"""Array and vector expressions, all evaluated in the JVM and in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of an array, 0 if empty."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance, from the differences themselves."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def activation(score: Column, most: float = 10.0) -> Column:
    """min(log(1 + relu(score)), most)."""
    return F.least(F.log1p(F.greatest(score, F.lit(0.0))), F.lit(most))


def bucket(buckets: int, *parts: Column) -> Column:
    """A number from 0 to buckets-1 by the md5 of the parts joined by a bar."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets).cast("int")
