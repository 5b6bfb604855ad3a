"""Lines that join the points around a face by branching, and the ends of segments in cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import vec
from lattica.operators.gvd import FACE

ENDS = [e + a for e in "ab" for a in "xyz"]


def rim_place() -> Column:
    """How far around its face a point q is from the face's low corner, first along the earlier axis."""
    def of(a: str, b: str) -> Column:
        u, v = F.col(f"q{a}") - F.col(f"f{a}"), F.col(f"q{b}") - F.col(f"f{b}")
        return F.when(v == 0, u).when(u == F.col("w"), F.col("w") + v).when(v == F.col("w"), 3 * F.col("w") - u).otherwise(4 * F.col("w") - v)

    return F.when(F.col("normal") == 0, of("y", "z")).when(F.col("normal") == 1, of("x", "z")).otherwise(of("x", "y"))


def branch(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, point, line ends) of many rings of as many points each: rings is (rows, n, 3), n at least 3.

    The closest two neighbours and the point farthest from the first of them are joined at
    their mean, which then takes the place of the two, until three points are left, which
    are all joined. Ties go to the earlier point. A joined point counts as the first it was made from.
    """
    rows = np.arange(len(points))
    name = np.tile(np.arange(points.shape[1]), (len(points), 1))
    size2 = lambda v: v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1] + v[..., 2] * v[..., 2]
    while True:
        n = points.shape[1]
        one = size2(points - np.roll(points, -1, axis=1)).argmin(1)
        two = (one + 1) % n
        far = size2(points - points[rows, one][:, None]).argmax(1)
        centre = (points[rows, one] + points[rows, two] + points[rows, far]) / 3
        for at in (one, two, *([3 - one - two] if n == 3 else [])):
            yield rows, name[rows, at], np.concatenate([points[rows, at], centre], axis=1)
        if n == 3:
            return
        keep = np.ones((len(rows), n), bool)
        keep[rows, two] = False
        points = points.copy()
        points[rows, one] = centre
        points, name = points[keep].reshape(len(rows), n - 1, 3), name[keep].reshape(len(rows), n - 1)


def face_branches(rims: DataFrame) -> DataFrame:
    """(normal, fx, fy, fz, w, la, lb, ax .. bz): lines that join the points on each face's rim.

    rims: FACE, la, lb, qx, qy, qz, one row a point. Two points are joined by one line, from
    the first around the rim; more are joined by branching; one alone gives none. A line has
    the labels of the point it begins at. Faces have as many points as lattice edges on
    their rim, so a face's ring is small; rings of one length are handled together.
    """
    ring = F.array_sort(F.collect_list(F.struct(rim_place().alias("s"), "qx", "qy", "qz", "la", "lb")))
    held = rims.groupBy(*FACE).agg(ring.alias("ring")).filter(F.size("ring") > 1)
    at = lambda i, c: F.get("ring", i)[c]
    pairs = held.filter(F.size("ring") == 2).select(*FACE, at(0, "la").alias("la"), at(0, "lb").alias("lb"), *[at(i, f"q{a}").alias(e + a) for i, e in enumerate("ab") for a in "xyz"])
    kinds = dict(rims.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (*FACE, "la", "lb")] + [f"{c} double" for c in ENDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(len(FACE)).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                flat = part.column(len(FACE)).flatten()
                points = np.stack([flat.field(f"q{a}").to_numpy(zero_copy_only=False) for a in "xyz"], axis=-1).reshape(-1, n, 3)
                for rows, point, ends in branch(points):
                    take = pa.array(rows * n + point)
                    cols = [part.column(i).take(pa.array(rows)) for i in range(len(FACE))] + [flat.field(c).take(take) for c in ("la", "lb")]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(c)) for c in ends.T]], [*FACE, "la", "lb", *ENDS])

    return pairs.unionAll(held.filter(F.size("ring") > 2).mapInArrow(run, schema))


def cell_ends(cells: DataFrame, side: int) -> DataFrame:
    """Adds n, x0, y0, x1, y1: where a row's segment (ax .. by) meets the sides of its cell (cx, cy), in order along it.

    n counts the distinct places; one place fills the first pair only, none leaves nulls. Of more
    than two, the pair whose direction agrees best with the segment's is taken, ties by order.
    A place on a corner is found once, as whole coordinates give it exactly.
    """
    a, b = vec.point("a", 2), vec.point("b", 2)
    v, low = vec.sub(b, a), (F.col("cx") * side, F.col("cy") * side)
    high = tuple(c + side for c in low)
    found = []
    for k in (0, 1):
        d = F.nullif(v[k].cast("double"), F.lit(0.0))
        for bound in (low[k], high[k]):
            other = a[1 - k] + (v[1 - k] * (bound - a[k])) / d
            t = (bound - a[k]) / d
            p = (bound.cast("double"), other) if k == 0 else (other, bound.cast("double"))
            ok = (t >= 0) & (t <= 1) & (other >= low[1 - k]) & (other <= high[1 - k])
            found.append(F.when(ok, F.struct(p[0].alias("x"), p[1].alias("y"))))
    forward = (v[0] > 0) | ((v[0] == 0) & (v[1] > 0))
    places = F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda p: p.isNotNull())))
    rows = cells.withColumn("_p", F.when(forward, places).otherwise(F.reverse(places)))

    def rated(p: Column, q: Column) -> Column:
        u = (q["x"] - p["x"], q["y"] - p["y"])
        return F.round(F.abs(vec.dot(u, v)) / F.nullif(vec.length(u) * vec.length(v), F.lit(0.0)), 9)

    pairs = F.flatten(F.transform("_p", lambda p, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda q, j: F.struct(rated(p, q).alias("r"), (-i).alias("i"), (-j).alias("j"), p.alias("p"), q.alias("q")))))
    best = F.array_max(pairs)
    rows = rows.withColumn("n", F.size("_p")).withColumn("_b", F.when(F.size("_p") > 2, F.struct(best["p"].alias("p"), best["q"].alias("q"))).otherwise(F.struct(F.get("_p", 0).alias("p"), F.get("_p", 1).alias("q"))))
    return rows.select(*cells.columns, "n", *[F.col(f"_b.{s}.{c}").alias(c + e) for s, e in (("p", "0"), ("q", "1")) for c in "xy"])
