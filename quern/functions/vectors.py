"""Vectors as arrays: products, norms, distances and similarities in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def same_length(a: Column, b: Column) -> Column:
    """``a``, or an error if the lengths differ."""
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors of different length")))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(same_length(a, b)), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(same_length(a, b)), doubles(b), lambda x, y: (x - y) * (x - y))))


def pack(v: Column) -> Column:
    """Little-endian float32 bytes, for stores that keep vectors as blobs."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return run(v)


def unpack(b: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))

    return run(b)


def average(column: Column, size: int) -> Column:
    """Aggregate: the mean vector, one mean for each of ``size`` places."""
    return F.array(*[F.avg(F.get(column, F.lit(i)).cast("double")) for i in range(size)])
