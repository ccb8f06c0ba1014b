"""Vectors of floating-point numbers as vectors of whole numbers, so that what follows can be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = float(1 << 61)


def whole(vectors: DataFrame, vec_id: str, vector: str, scale: float, shift: int = 0) -> DataFrame:
    """vec_id and x = floor(scale * c) + shift of every entry c, as longs. Rows whose vector is null, or holds an entry that is null, not finite or, after
    scaling, 2^61 or more, are left out. Ids stay as they are, nulls and repeats too."""
    entries = F.col(vector).cast("array<double>")
    # Not a number compares as larger than any number.
    usable = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c * F.lit(float(scale))) < F.lit(LARGEST)))
    x = F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift))
    return vectors.where(usable).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """An Arrow array of lists of longs, all of one length, none null, as rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), width)
