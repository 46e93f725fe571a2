"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def width_of(df: DataFrame, vector: str) -> int:
    """The length of df's vectors, told by one of them; 0 without any."""
    found = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return found[0] if found else 0


def dot_of(a: Column, b: Column, width: int) -> Column:
    """The dot product of vectors of a known length, written out so that it is compiled with the stage around it."""
    total = F.lit(0.0)
    for i in range(width):
        total = total + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
    return total


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def without_axes(a: Column, first: int) -> Column:
    """The vector without its first axes."""
    return F.slice(a, F.lit(first + 1), F.greatest(F.size(a) - first, F.lit(0)))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mean_by(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, out: str = "vec") -> DataFrame:
    """The element-wise (weighted) mean of each group's vectors; a row whose vector is null or has a null element is left out.

    One dense buffer a group, combined before the shuffle.
    """
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    w = F.lit(1.0) if weight is None else weight
    dense = df.where(whole).select(*keys, array_to_vector(F.col(vector)).alias("_v"), w.alias("_w"))
    return dense.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias(out))
