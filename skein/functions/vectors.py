"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is null, empty, zero, or of another length."""
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    n = norm(a) * norm(b)
    return F.when(ok & (n > 0), dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    """The array divided by its length; a zero array stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(1.0))


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean. Arrays of a group must have one length."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))
