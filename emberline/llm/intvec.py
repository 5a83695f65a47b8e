"""Vectors as whole numbers: usable rows, exact inner products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F


def usable_vectors(vectors: DataFrame, scale: int, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """((vec_id, *extra, x array<int>), dims): components floor(scale * component), the component as double.

    No part take rows without vec_id or value in `extra`, vectors null, empty or holding null or non-finite components, of a length
    other than the most common (the larger of equals), or so large (some 2^31 / sqrt(dims)) that inner products need not fit 62 bits.
    """
    whole = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *extra, F.col("embedding").cast("array<double>").alias("e"))
             .dropna().filter(F.size("e") > 0)
             .filter(~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))))
    common = whole.groupBy(F.size("e").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 1
    limit = float(math.isqrt(2 ** 62 // dims) - 1)
    fit = whole.filter((F.size("e") == dims) & ~F.exists("e", lambda v: F.abs(v) * scale >= limit))
    return fit.select("vec_id", *extra, F.transform("e", lambda v: F.floor(v * F.lit(float(scale))).cast("int")).alias("x")), dims


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype=np.int32).tobytes()


def unpacked(parts, dims: int) -> np.ndarray:
    """Rows of packed vectors, one below the other."""
    return np.frombuffer(b"".join(parts), dtype=np.int32).reshape(-1, dims)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b, as long integers."""
    most = lambda v: int(np.abs(v.astype(np.int64)).max(initial=0))
    if a.shape[1] * most(a) * most(b) < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
