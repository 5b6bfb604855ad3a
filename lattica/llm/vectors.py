"""Vectors as whole components, and what their operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are at most this large in absolute value, so that sums of products stay within 64 bits.
WIDEST = 1 << 24


def whole_components(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id long, label, whole array<long>) of the rows whose vector is finite; component x is floor(scale * x)."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.filter(vector.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("whole"))


def extent(whole: DataFrame) -> tuple[int, int, int]:
    """(rows, longest vector, largest absolute component) of a table of whole components."""
    most = F.coalesce(F.array_max(F.transform("whole", lambda x: F.greatest(x, -x - 1))), F.lit(0))  # floors of large negatives don't overflow
    n, dim, widest = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("whole")), F.lit(0)), F.coalesce(F.max(most), F.lit(0))).first()
    if widest > WIDEST:
        raise ValueError(f"components of up to {WIDEST} are supported, not {widest}")
    return n, dim, widest


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists of whole numbers as one array; shorter rows end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def unpack(values: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    """Binary values of one size as an array (rows, *shape)."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
    data = np.frombuffer(values.buffers()[2], np.uint8) if len(values) and size else np.zeros(0, np.uint8)
    return data[at[0] : at[0] + size * len(values)].copy().view(kind).reshape(len(values), *shape)


def pack(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


#: Groups up to which their totals are broadcast; above it they are joined by shuffle.
FEW_GROUPS = 1 << 16


def group_total(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """Adds each group's sum of a value, nulls in ``by`` being one group; a hot group's rows stay where they are or are dealt by AQE."""
    sums = rows.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(name))
    if sums.count() <= FEW_GROUPS:
        sums = F.broadcast(sums)
    return rows.join(sums, rows[by].eqNullSafe(sums["_by"])).drop("_by")
