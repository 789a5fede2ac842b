"""Integer vectors: what operators 11 and 13 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components saturate here, so that sums over a vector of 8,192 components fit a long.
SATURATION = 1 << 24


def finite(vec: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    inside = F.forall(vec.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & inside, F.lit(False))


def integers(vec: Column, scale: int) -> Column:
    """Each component x as the integer floor(scale * x), computed in doubles."""
    bound = float(SATURATION)
    return F.transform(
        vec.cast("array<double>"),
        lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(bound)), F.lit(-bound))).cast("int"),
    )


def matrix(column: pa.Array, dims: int, kind: type = np.int64) -> np.ndarray:
    """The rows of a list column whose lists all have ``dims`` elements."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices as 64-bit integers. Where no partial sum can
    leave the doubles' exact range, the product is taken in doubles, which is faster."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)
