"""The nearest triangle of every point in space, by grid cells and blocks of points and triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import geom, solids, vec
from lattica.functions.solids import CORNERS
from lattica.operators import spatial
from lattica.session import write_and_reread

#: Triangles that every point is held against for its first bound.
FIRST = 256
#: Triangles of a cell that are one block, and points.
BLOCK, POINTS = 4096, 1024
#: Pairs of blocks in one Arrow batch.
ROWS = 128
#: Cells of the grid along the longest axis, about.
GRID = 16
#: Pairs that are tested at once.
PAIRS = 1 << 19
AXES = ["x", "y", "z"]


def _reach(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2) * (1 + 1e-9) + 1e-6  # a little more, for rounding


def _nearest(points: list[np.ndarray], most: np.ndarray, t: solids.Solid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, triangle, d2) of the nearest triangles of each point, all equally near ones, that are no farther than ``most``.

    A few triangles come first and lower the bounds; of the others, those are worked out whose plane and box are near enough.
    """
    best = most.copy()
    n = [c.astype(np.float64) for c in solids.normal(t)]
    offset = sum(a * b for a, b in zip(n, t[0], strict=True))
    size = np.sqrt(sum(c * c for c in n))
    low, high = solids.extent(t)
    flat = np.column_stack(points).astype(np.float64)
    kept: list[tuple[np.ndarray, ...]] = []
    many, first = len(size), 0
    for last in (64, 512, many):
        last = min(last, many)
        if first >= last:
            break
        plane = np.stack([c[first:last] for c in n])
        step = max(1, PAIRS // (last - first))
        for own in range(0, len(best), step):
            at = slice(own, own + step)
            reach = _reach(best[at])
            # whole numbers below 2**53, so the products are exact
            i, j = np.nonzero(np.abs(flat[at] @ plane - offset[first:last]) <= reach[:, None] * size[first:last])
            i, j = i + own, j + first
            apart = 0
            for k in range(3):
                gap = np.maximum(np.maximum(low[k][j] - points[k][i], points[k][i] - high[k][j]), 0)
                apart = apart + gap * gap
            near = np.flatnonzero(apart <= reach[i - own] ** 2)
            i, j = i[near], j[near]
            d2 = solids.distance2([c[i] for c in points], solids.taken(t, j))
            np.minimum.at(best, i, d2)
            keep = np.flatnonzero(d2 <= best[i])
            kept.append((i[keep], j[keep], d2[keep]))
        first = last
    i, j, d2 = (np.concatenate([k[c] for k in kept] or [np.zeros(0, np.int64)]) for c in range(3))
    keep = np.flatnonzero(d2 <= best[i])
    return i[keep], j[keep], d2[keep]


def _bounded(queries: DataFrame, few: solids.Solid, cells: np.ndarray, side: int) -> DataFrame:
    """Adds _cell and _most: for each point, the cells with triangles that it may have its nearest one in, and a bound on its squared distance."""
    step = max(1, PAIRS // max(len(few[0][0]), len(cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                p = [c[:, None] for c in solids.numbers(batch, AXES)]
                most = solids.distance2(p, [[c[None] for c in corner] for corner in few]).min(1)
                apart = 0
                for k in range(3):
                    low = cells[None, :, k] * side
                    gap = np.maximum(np.maximum(low - p[k], p[k] - low - side), 0)
                    apart = apart + gap * gap
                i, j = np.nonzero(apart <= _reach(most)[:, None] ** 2)
                held = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(j), pa.array(most[i])], [*batch.schema.names, "_cell", "_most"])

    return queries.mapInArrow(run, "x long, y long, z long, _cell long, _most double")


def _blocks(rows: DataFrame, size: int, parts: int, name: str) -> DataFrame:
    """(_cell, ``name``): the rows of each cell in arrays of about ``size``, dealt by what they hold."""
    own = [c for c in rows.columns if c != "_cell"]
    full = rows.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    dealt = rows.join(F.broadcast(full), "_cell").withColumn("_block", F.pmod(F.xxhash64(*own), F.col("_blocks")))  # cells are bounded
    return dealt.repartition(parts, "_cell").groupBy("_cell", "_block").agg(F.collect_list(F.struct(*own)).alias(name)).drop("_block")


def nearest_triangle(queries: DataFrame, triangles: DataFrame, label: str, tie: list[Column], extra: dict[str, Column]) -> DataFrame:
    """(x, y, z, label, d2, extra..): the nearest triangle (ax .. tz) of each distinct point by squared distance; ties by ``tie``, then label, then extra.

    Coordinates are whole. ``tie`` and ``extra`` are columns of the triangles; those with a null corner, and
    points with a null, take no part. Triangles with equal corners are one, with the first of
    their ties. Every point gets a bound from FIRST triangles, is sent to the cells with triangles that lie within
    it, and meets their triangles block by block. There are at most (GRID + 2)**3 cells, whatever the table's size.
    """
    own = F.struct(*[e.alias(f"_tie{i}") for i, e in enumerate(tie)], F.col(label).alias("_label"), *[e.alias(f"_extra_{c}") for c, e in extra.items()])
    solid = write_and_reread(triangles.dropna(subset=CORNERS).groupBy(*CORNERS).agg(F.min(own).alias("_own")), "solid-triangles")
    points = write_and_reread(queries.select(*AXES).dropna().distinct(), "solid-points")
    n, wanted = solid.count(), points.count()
    told = lambda rows: rows.select(*AXES, F.col("_own._label").alias("label"), "d2", *[F.col(f"_own._extra_{c}").alias(c) for c in extra])
    if not n or not wanted:
        return told(points.limit(0).crossJoin(solid.limit(0)).withColumn("d2", F.lit(0.0)))
    span = lambda rows, a, names: [f(g(*names) if len(names) > 1 else F.col(names[0])).cast("long").alias(f"{k}{a}") for k, f, g in (("l", F.min, F.least), ("h", F.max, F.greatest))]
    box = solid.agg(*[c for a in AXES for c in span(solid, a, [p + a for p in "abt"])]).first()
    around = points.agg(*[c for a in AXES for c in span(points, a, [a])]).first()
    if max(max(box[f"h{a}"], around[f"h{a}"]) - min(box[f"l{a}"], around[f"l{a}"]) for a in AXES) > solids.SPAN:
        p, t = vec.point("", 3), tuple(vec.point(c, 3) for c in "abt")
        low, high = vec.least(vec.least(*t[:2]), t[2]), vec.greatest(vec.greatest(*t[:2]), t[2])
        every = triangles.dropna(subset=CORNERS)
        side = 1 + max(box[f"h{a}"] - box[f"l{a}"] for a in AXES) // GRID
        return spatial.nearest(points, every, geom.point_triangle_distance2(p, *t), AXES, p, (low, high), label, tie, side, extra)
    side = 1 << max(0, (max(box[f"h{a}"] - box[f"l{a}"] for a in AXES) // GRID - 1).bit_length())
    placed = write_and_reread(solids.cells_of(solid.repartition(max(8, n // (1 << 13))), side), "solid-cells")
    found = sorted(tuple(r) for r in placed.select("cx", "cy", "cz").distinct().collect())  # bounded by the grid
    cells = np.array(found, np.int64)
    number = points.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(found)], "cx long, cy long, cz long, _cell long")
    turn = F.pmod(F.xxhash64(*CORNERS), F.lit(-(-n // FIRST)))
    few = solid.filter(turn == 0).limit(2 * FIRST).toArrow() if n > FIRST else solid.toArrow()
    if not few.num_rows:
        few = solid.limit(FIRST).toArrow()
    few = solids.corners(few.combine_chunks().to_batches()[0])
    look = write_and_reread(_bounded(points.repartition(max(8, wanted // (1 << 12))), few, cells, side), "solid-look")
    parts = max(32, min(len(found), placed.count() >> 13))
    one = _blocks(placed.join(F.broadcast(number), ["cx", "cy", "cz"]).select("_cell", *CORNERS, "_own"), BLOCK, parts, "held")
    two = _blocks(look, POINTS, parts, "points")
    met = one.join(two, "_cell").select("points", "held")
    kind = solid.schema["_own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in zip(batch.column(0), batch.column(1), strict=True):
                at, held = at.values, held.values
                p = solids.numbers(at, AXES)
                i, j, d2 = _nearest(p, at.field("_most").to_numpy(zero_copy_only=False), solids.corners(held))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[i]) for c in p], pa.array(d2), held.field("_own").take(pa.array(j))], [*AXES, "d2", "_own"])

    near = met.mapInArrow(run, f"x long, y long, z long, d2 double, _own {kind}")
    conf, name = points.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(ROWS))  # for this step alone: its rows hold whole blocks
    try:
        best = write_and_reread(near.groupBy(*AXES).agg(F.min(F.struct("d2", "_own")).alias("_b")), "solid-nearest")
    finally:
        conf.set(name, before)
    return told(best.select(*AXES, "_b.d2", "_b._own"))
