"""Triangles in space as arrays: the tests of ``geom`` for many rows at once.

As column expressions these are too long for Spark to compile when several stand in one
step. Rows are Arrow batches with whole-numbered corners a, b and t; the operations are
those of ``geom`` in the same order, so results are equal to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

CORNERS = [c + a for c in "abt" for a in "xyz"]
#: Coordinates up to which ``meets_cube`` stays within 64 bits, and spans up to which ``distance2`` does.
WIDEST, SPAN = 1 << 18, 26_000
#: Cells of triangles' boxes that are tested at once.
TOGETHER = 1 << 17

Solid = list[list[np.ndarray]]


def numbers(rows: pa.RecordBatch | pa.StructArray, names: list[str]) -> list[np.ndarray]:
    of = rows.column if isinstance(rows, pa.RecordBatch) else rows.field
    return [of(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in names]


def corners(rows: pa.RecordBatch | pa.StructArray) -> Solid:
    flat = numbers(rows, CORNERS)
    return [flat[k : k + 3] for k in (0, 3, 6)]


def taken(t: Solid, at: np.ndarray | slice) -> Solid:
    return [[x[at] for x in p] for p in t]


def _sub(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
    return [a - b for a, b in zip(p, q, strict=True)]


def _dot(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def _cross(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def normal(t: Solid) -> list[np.ndarray]:
    return _cross(_sub(t[1], t[0]), _sub(t[2], t[0]))


def extent(t: Solid) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The low and high corner of each triangle's box."""
    return tuple([f(f(t[0][i], t[1][i]), t[2][i]) for i in range(3)] for f in (np.minimum, np.maximum))


def meets_cube(t: Solid, low: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Whether each triangle meets its closed cube, as ``geom.triangle_box_overlap``."""
    least, most = extent(t)
    ok = np.ones(len(size), bool)
    for i in range(3):
        ok &= (least[i] <= low[i] + size) & (most[i] >= low[i])
    left = np.flatnonzero(ok)
    t, low, size = taken(t, left), [c[left] for c in low], size[left]
    if len(left) and any(max(-int(c.min()), int(c.max())) > WIDEST for p in t for c in p):
        raise ValueError(f"coordinates of triangles that meet a cell may be {WIDEST} at most")
    n = normal(t)
    keep = np.abs(_dot(n, [t[0][i] * 2 - (low[i] * 2 + size) for i in range(3)])) <= (np.abs(n[0]) + np.abs(n[1]) + np.abs(n[2])) * size
    ok[left[~keep]] = False
    left, t, low, size = left[keep], taken(t, keep), [c[keep] for c in low], size[keep]
    moved = [[p[i] * 2 - (low[i] * 2 + size) for i in range(3)] for p in t]
    keep = np.ones(len(size), bool)
    for k in range(3):
        edge = _sub(t[(k + 1) % 3], t[k])
        for i in range(3):
            j, m = (i + 1) % 3, (i + 2) % 3
            one, two = (edge[j] * v[m] - edge[m] * v[j] for v in (moved[k], moved[(k + 2) % 3]))
            reach = (np.abs(edge[j]) + np.abs(edge[m])) * size
            keep &= (np.minimum(one, two) <= reach) & (np.maximum(one, two) >= -reach)
    ok[left] = keep
    return ok


def spread(wide: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, turn): every turn below each row's count, whole rows together, about TOGETHER at once."""
    until = np.cumsum(wide)
    begin = 0
    while begin < len(wide):
        before = int(until[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(until, before + TOGETHER, "right")))
        row = np.repeat(np.arange(begin, end), wide[begin:end])
        if len(row):
            yield row, before + np.arange(len(row)) - (until[row] - wide[row])
        begin = end


def cells_met(t: Solid, side: int, count: int, known: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell): each closed cell of a grid of ``count`` along each axis, numbered in the order of cx, cy, cz, that a triangle meets.

    A row's cells come together. Pairs that are ``known`` are left out before they are tested.
    """
    low, high = extent(t)
    first = [np.maximum(-(-c // side) - 1, 0) for c in low]
    wide = [np.maximum(np.minimum(c // side, count - 1) - a + 1, 0) for a, c in zip(first, high, strict=True)]
    for row, turn in spread(wide[0] * wide[1] * wide[2]):
        turn, z = np.divmod(turn, wide[2][row])
        x, y = np.divmod(turn, wide[1][row])
        at = [c[row] + k for c, k in zip(first, (x, y, z), strict=True)]
        cell = (at[0] * count + at[1]) * count + at[2]
        if known:
            fresh = np.flatnonzero(~known(row, cell))
            row, cell, at = row[fresh], cell[fresh], [c[fresh] for c in at]
        meets = np.flatnonzero(meets_cube(taken(t, row), [c * side for c in at], np.full(len(row), side, np.int64)))
        if len(meets):
            yield row[meets], cell[meets]


def _segment_distance2(p: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    d = _sub(b, a)
    n = _dot(d, d).astype(np.float64)
    along = _dot(_sub(p, a), d)
    t = np.divide(along, n, out=np.zeros(np.broadcast(along, n).shape), where=n > 0)
    t = np.maximum(0.0, np.minimum(1.0, t))
    off = [c - (x + t * y) for c, x, y in zip(p, a, d, strict=True)]
    return _dot(off, off)


def foot_on_segment(p: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The point of each segment nearest to p, as ``geom.closest_on_segment``, in the plane or in space."""
    d = _sub(b, a)
    n = sum(c * c for c in d).astype(np.float64)
    along = sum(c * q for c, q in zip(_sub(p, a), d, strict=True)).astype(np.float64)
    t = np.maximum(0.0, np.minimum(1.0, np.divide(along, n, out=np.zeros(n.shape), where=n > 0)))
    return [x.astype(np.float64) + t * c.astype(np.float64) for x, c in zip(a, d, strict=True)]


def distance2(p: list[np.ndarray], t: Solid) -> np.ndarray:
    """Squared distances of points and triangles, as ``geom.point_triangle_distance2``."""
    n = normal(t)
    n2 = _dot(n, n).astype(np.float64)
    inside = n2 > 0
    for k in range(3):
        inside = inside & (_dot(_cross(_sub(t[(k + 1) % 3], t[k]), _sub(p, t[k])), n) >= 0)
    height = _dot(_sub(p, t[0]), n).astype(np.float64)
    edges = np.minimum(np.minimum(_segment_distance2(p, t[0], t[1]), _segment_distance2(p, t[1], t[2])), _segment_distance2(p, t[2], t[0]))
    return np.where(inside, np.divide(height * height, n2, out=np.zeros(height.shape), where=n2 > 0), edges)


def foot(p: list[np.ndarray], t: Solid) -> list[np.ndarray]:
    """The point of each triangle nearest to p, as ``geom.closest_on_triangle``; beyond SPAN in whole numbers of any size."""
    if len(p[0]) and max(int(np.abs(a - c).max()) for q in t for a, c in zip(q, p, strict=True)) > SPAN:
        p, t = [c.astype(object) for c in p], [[c.astype(object) for c in q] for q in t]
    n = normal(t)
    n2 = _dot(n, n).astype(np.float64)
    inside, feet, far = n2 > 0, [], []
    for k in range(3):
        a, b = t[k], t[(k + 1) % 3]
        inside = inside & (_dot(_cross(_sub(b, a), _sub(p, a)), n) >= 0).astype(bool)
        feet.append(foot_on_segment(p, a, b))
        off = [c - x for c, x in zip(p, feet[-1], strict=True)]
        far.append(_dot(off, off).astype(np.float64))
    lift = np.divide(_dot(_sub(p, t[0]), n).astype(np.float64), n2, out=np.zeros(n2.shape), where=n2 > 0)
    first, second = (far[0] <= far[1]) & (far[0] <= far[2]), far[1] <= far[2]
    return [np.where(inside, p[i] - lift * n[i].astype(np.float64), np.where(first, feet[0][i], np.where(second, feet[1][i], feet[2][i]))).astype(np.float64) for i in range(3)]


def _mapped(rows: DataFrame, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], more: str = "") -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)

    schema = StructType([*rows.schema.fields, *[StructField(name, LongType()) for name in more.split()]])
    return rows.mapInArrow(each, schema)


def in_cells(rows: DataFrame, width: int) -> DataFrame:
    """The rows of triangles that meet their cell (level, cx, cy, cz) of a lattice; a null corner meets none."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.int64(width) >> batch.column("level").to_numpy(zero_copy_only=False).astype(np.int64)
        low = [batch.column(f"c{a}").to_numpy(zero_copy_only=False) * size for a in "xyz"]
        yield batch.filter(pa.array(meets_cube(corners(batch), low, size)))

    return _mapped(rows.dropna(subset=CORNERS), run)


def cells_of(rows: DataFrame, side: int, count: int | None = None) -> DataFrame:
    """Adds cx, cy, cz: each closed cell of a grid that a triangle meets, among the first ``count`` along each axis if given."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = corners(batch)
        low, high = extent(t)
        first, last = [-(-c // side) - 1 for c in low], [c // side for c in high]
        if count is not None:
            first, last = [np.maximum(c, 0) for c in first], [np.minimum(c, count - 1) for c in last]
        wide = [np.maximum(b - a + 1, 0) for a, b in zip(first, last, strict=True)]
        boxes = wide[0] * wide[1] * wide[2]
        until = np.cumsum(boxes)
        total = int(until[-1]) if len(until) else 0
        for begin in range(0, total, TOGETHER):
            turn = np.arange(begin, min(begin + TOGETHER, total))
            row = np.searchsorted(until, turn, "right")
            place = turn - (until[row] - boxes[row])
            cell = [first[0][row] + place % wide[0][row], first[1][row] + place // wide[0][row] % wide[1][row], first[2][row] + place // (wide[0][row] * wide[1][row])]
            keep = np.flatnonzero(meets_cube(taken(t, row), [c * side for c in cell], np.full(len(row), side, np.int64)))
            held = batch.take(pa.array(row[keep]))
            yield pa.RecordBatch.from_arrays([*held.columns, *[pa.array(c[keep]) for c in cell]], [*batch.schema.names, "cx", "cy", "cz"])

    return _mapped(rows.dropna(subset=CORNERS), run, "cx cy cz")
