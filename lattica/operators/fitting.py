"""Boxes fitted between pairs of segments by marching along their middle, and the sample points beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import geom
from lattica.session import write_and_reread

ENDS = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
#: Pairs that march together, and pairs of a task.
TOGETHER, PART_PAIRS = 1 << 14, 1 << 16


def neighbour_pairs(segments: DataFrame) -> DataFrame:
    """Each segment with the next but one of its polyline: label, ord, ax.. by, cx, cy, dx, dy."""
    line = Window.partitionBy("label").orderBy("ord")
    ends = [F.lead(c, 2).over(line).alias(to) for c, to in (("ax", "cx"), ("ay", "cy"), ("bx", "dx"), ("by", "dy"))]
    return segments.select("label", "ord", "ax", "ay", "bx", "by", *ends).filter("cx is not null")


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt((p[:, 0] - q[:, 0]) * (p[:, 0] - q[:, 0]) + (p[:, 1] - q[:, 1]) * (p[:, 1] - q[:, 1]))


def _chosen(when: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.where(when[:, None], p, q)


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sign((b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0]))


def _arm(x: np.ndarray, to: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the arm from a crossing leaves the box around it, and whether it does."""
    d = to - x
    reach = np.abs(d).max(1)
    t = np.divide(least / 2, reach, out=np.ones(len(x)), where=reach > 0)
    return x + d * t[:, None], t < 1


def wedges(ends: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, ends): pairs (rows of ax, ay, .. dx, dy) as pairs that don't cross, opening from a and c toward b and d.

    A pair that doesn't cross is part 0, turned so that a and c are its nearer ends. One
    that crosses becomes its crossing (part 0, all four ends there) and up to two wedges
    (parts 1 and 2) of the arms on one side each, which begin where they leave the box of
    width ``least`` around the crossing; an arm that ends in it has no wedge.
    """
    a, b, c, d = (ends[:, 2 * k : 2 * k + 2] for k in range(4))
    crosses = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
    plain, met = np.flatnonzero(~crosses), np.flatnonzero(crosses)
    made = []
    a, b, c, d = (ends[plain, 2 * k : 2 * k + 2] for k in range(4))
    across = _far(a, c) + _far(b, d) > _far(a, d) + _far(b, c)
    one, two = _chosen(across, d, c), _chosen(across, c, d)
    turned = _far(b, two) < _far(a, one)
    made.append((plain, 0, np.hstack([_chosen(turned, q, p) for p, q in ((a, b), (b, a), (one, two), (two, one))])))
    a, b, c, d = (ends[met, 2 * k : 2 * k + 2] for k in range(4))
    u, v, w = b - a, d - c, c - a
    t = (w[:, 0] * v[:, 1] - w[:, 1] * v[:, 0]) / (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    x = a + t[:, None] * u
    made.append((met, 0, np.hstack([x] * 4)))
    apart = (a[:, 0] - x[:, 0]) * (c[:, 0] - x[:, 0]) + (a[:, 1] - x[:, 1]) * (c[:, 1] - x[:, 1]) < 0
    for part, (own, mate) in enumerate(((a, _chosen(apart, d, c)), (b, _chosen(apart, c, d))), 1):
        (start, goes), (other, goes_too) = _arm(x, own, least), _arm(x, mate, least)
        both = goes & goes_too
        made.append((met[both], part, np.hstack([start, own, other, mate])[both]))
    return np.concatenate([m[0] for m in made]), np.concatenate([np.full(len(m[0]), m[1], np.int32) for m in made]), np.vstack([m[2] for m in made])


def march(ends: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step, (rows, values): the boxes of all wedges (rows of ax .. dy) that still march.

    values: x and y of the centre, size, and two samples. From a place on the first segment
    the box spans to the nearest point of the second, is that wide, ``least`` at least, and
    the place moves on by its size, until the longer segment's length is used up. The samples lie a quarter of
    the way in from both points.
    """
    at = np.zeros(len(ends))
    a, b, c, d = (ends[:, 2 * k : 2 * k + 2] for k in range(4))
    length = np.maximum(_far(a, b), _far(c, d))
    rows = np.arange(len(ends))
    while len(rows):
        a, b, c, d = (ends[rows, 2 * k : 2 * k + 2] for k in range(4))
        t = np.divide(at[rows], length[rows], out=np.zeros(len(rows)), where=length[rows] > 0)
        p = a + t[:, None] * (b - a)
        v = d - c
        n = v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1]
        s = np.divide((p[:, 0] - c[:, 0]) * v[:, 0] + (p[:, 1] - c[:, 1]) * v[:, 1], n, out=np.zeros(len(rows)), where=n > 0)
        q = c + np.clip(s, 0.0, 1.0)[:, None] * v
        size = np.maximum(_far(p, q), least)
        yield rows, np.column_stack([(p + q) / 2, size, p + (q - p) / 4, q + (p - q) / 4])
        at[rows] += size
        rows = rows[at[rows] <= length[rows]]


def fit_boxes(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs' other columns with part, step, x, y, size, and the samples px, py, qx, qy of each box.

    Pairs that cross are split at their crossing (``wedges``). ``least`` has to be positive,
    so every march ends. A pair with a null or not finite end has no boxes, a segment without length
    is a point, and an empty table gives no rows.
    """
    if least <= 0:
        raise ValueError("least has to be positive")
    own = [c for c in pairs.columns if c not in ENDS]
    finite = geom.all_of(*[F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in ENDS])
    rows = write_and_reread(pairs.filter(finite).select(*own, *[F.col(c).cast("double") for c in ENDS]), "fitting-pairs")
    kinds = dict(rows.dtypes)
    places = ["x", "y", "size", "px", "py", "qx", "qy"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "part int", "step int", *[f"{c} double" for c in places]])

    def boxes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, part, ends = wedges(np.column_stack([batch.column(len(own) + k).to_numpy(zero_copy_only=False) for k in range(8)]), least)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            at, step, values = (np.concatenate([h[k] for h in held]) for k in range(3))
            kept = [batch.column(k).take(pa.array(row[at])) for k in range(len(own))]
            return pa.RecordBatch.from_arrays([*kept, pa.array(part[at]), pa.array(step), *[pa.array(np.ascontiguousarray(c)) for c in values.T]], [*own, "part", "step", *places])

        for step, (at, values) in enumerate(march(ends, least)):
            held.append((at, np.full(len(at), step, np.int32), values))
            if sum(len(h[0]) for h in held) >= TOGETHER:
                yield told()
                held = []
        if held:
            yield told()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                yield from boxes(batch.slice(first, TOGETHER))

    # a pair makes many boxes, so few pairs are a task's work already
    return rows.repartition(max(8, rows.count() // PART_PAIRS)).mapInArrow(run, schema)
