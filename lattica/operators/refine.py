"""Refinement of the Morton radix tree by extra points until no leaf above the last level holds two labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, LongType, StructField, StructType

from lattica.functions import geom, planes, vec
from lattica.functions.morton import Resolution
from lattica.operators import octree
from lattica.operators.fitting import ENDS, fit_boxes
from lattica.operators.octree import FEW, OctreeOptions, children, overlap
from lattica.session import write_and_reread

CELL = ["level", "cx", "cy"]
#: The same beside two segments, whose ends have those names.
OWN = ["level", "gx", "gy"]
#: A box is at least the cell's side over this, so a cell gets a bounded number of samples a round.
FINENESS = 8
#: Unit cells up to which each level's cells are looked up at once.
MOST = 1 << 16


def inner_cells(points: DataFrame, level: int, r: Resolution) -> DataFrame:
    """(level, cx, cy): the cells of a level that hold at least two of the distinct points, broadcast if a level's cells are few."""
    cells = points.select(*[F.shiftright(a, r.bits - level).alias(f"c{a}") for a in "xy"])
    found = cells.groupBy("cx", "cy").count().filter("count > 1").select(F.lit(level).alias("level"), "cx", "cy")
    return F.broadcast(found) if 4**level <= FEW else found


def conflicts(cells: DataFrame) -> DataFrame:
    """(level, gx, gy, ax .. dy): cells with several labels, and a segment of the least and of the largest one."""
    row = F.struct("label", "ax", "ay", "bx", "by")
    both = cells.groupBy(*CELL).agg(F.min(row).alias("p"), F.max(row).alias("q")).filter("p.label <> q.label")
    return both.select("level", F.col("cx").alias("gx"), F.col("cy").alias("gy"), *[F.col(f"{s}.{e}{a}").alias(to + a) for s, e, to in (("p", "a", "a"), ("p", "b", "b"), ("q", "a", "c"), ("q", "b", "d")) for a in "xy"])


def extra_points(found: DataFrame, r: Resolution) -> DataFrame:
    """(x, y): samples of boxes fitted between the conflicting segments' parts in their cell.

    A cell that gets fewer than two distinct ones has its first and its last lattice point
    added, so that two points are in it and it is split.
    """
    side = F.call_function("shiftright", F.lit(r.width).cast("long"), F.col("level").cast("int"))
    corner = tuple(F.col(c) * side for c in ("gx", "gy"))
    far = tuple(c + side for c in corner)
    ends = {e: vec.point(e, 2) for e in "abcd"}
    cut = {}
    for p, q in (("a", "b"), ("c", "d")):
        cut[p], cut[q] = geom.clip_start(ends[p], ends[q], corner, far), geom.clip_start(ends[q], ends[p], corner, far)
    # in units of the smallest box, so that one least width serves all cells
    scaled = found.select(*OWN, *[((F.coalesce(c, e) - o) * FINENESS / side).alias(p + a) for p in "abcd" for a, c, e, o in zip("xy", cut[p], ends[p], corner, strict=True)])
    boxes = fit_boxes(write_and_reread(scaled, "refine-scaled"), 1.0)
    each = boxes.select(*OWN, F.explode(F.array(*[F.struct(F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y")) for s in "pq"])).alias("s"))
    at = {a: F.floor(F.col(f"s.{a}") * side / FINENESS).cast("long") + c for a, c in zip("xy", corner, strict=True)}
    inside = each.select(*OWN, at["x"].alias("x"), at["y"].alias("y")).filter(geom.in_half_open((F.col("x"), F.col("y")), corner, far)).distinct()
    inside = write_and_reread(inside, "refine-samples")
    enough = inside.groupBy(*OWN).count().filter("count > 1").select(*OWN)
    forced = found.select(*OWN).join(enough, OWN, "left_anti").select(F.explode(F.array(*[F.struct(*[v.alias(a) for a, v in zip("xy", p, strict=True)]) for p in (corner, tuple(c - 1 for c in far))])).alias("s"))
    return inside.select("x", "y").unionAll(forced.select("s.x", "s.y"))


def refine(points: DataFrame, segments: DataFrame, r: Resolution) -> tuple[DataFrame, DataFrame]:
    """(points x, y, level; cells level, cx, cy, n_labels): the tree's points after refinement, and its leaf cells with segments.

    segments: label, ax, ay, bx, by on the lattice of ``r``. A cell that holds two distinct
    points is split. A leaf above the last level that segments of several labels meet gets
    extra points (``extra_points``), so it is split too; they lie in the cell, so they change
    nothing beside it, and one pass from the root down settles the tree: it takes as many rounds as a
    code has bits for an axis. level is that of the cell for which a point was added, null for the
    given ones. Null coordinates and labels take no part; an empty table adds nothing.
    """
    o = OctreeOptions(max_level=r.bits, width=r.width)
    segs = segments.select("label", "ax", "ay", "bx", "by").dropna().distinct()
    if 4**r.bits <= MOST and all(isinstance(segs.schema[c].dataType, IntegralType) for c in planes.ENDS):
        return _refine_at_once(points, segs, r)
    return _refine_by_fronts(points, segs, r)


def _given(points: DataFrame) -> DataFrame:
    state = points.select(*[F.col(a).cast("long").alias(a) for a in "xy"]).dropna().distinct().withColumn("level", F.lit(None).cast("int"))
    return write_and_reread(state, "refine-points")


def _rows_in(segs: DataFrame, wanted: np.ndarray, level: int, r: Resolution) -> DataFrame:
    """(level, cx, cy, segment): the wanted cells of a level that each segment meets."""
    count, side = 1 << level, r.width >> level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, cell in planes.cells_met(planes.ends(batch), side, count):
                keep = np.flatnonzero(wanted[cell])
                cx, cy = np.divmod(cell[keep], count)
                held = batch.take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), level, np.int32)), pa.array(cx), pa.array(cy), *held.columns], [*CELL, *batch.schema.names])

    return segs.mapInArrow(run, StructType([StructField("level", IntegerType()), StructField("cx", LongType()), StructField("cy", LongType()), *segs.schema.fields]))


def _refine_at_once(points: DataFrame, segs: DataFrame, r: Resolution) -> tuple[DataFrame, DataFrame]:
    """``refine`` where a level's MOST cells fit the driver: which of them are open is sent to the tasks, so only rows of leaves are made, and of unit cells only their labels."""
    o = OctreeOptions(max_level=r.bits, width=r.width)
    segs, state, done = write_and_reread(segs, "refine-segments"), _given(points), []
    parts = 1 + segs.count() // octree.TOGETHER
    many = segs.agg(F.approx_count_distinct("label")).first()[0] > octree.LABELS
    dealt = segs.repartition(parts, "label") if many else segs.repartition(parts)
    labels = F.count_distinct("label").cast("int").alias("n_labels")

    def inner(level: int) -> np.ndarray:
        found = np.zeros((1 << level,) * 2, bool)
        for _, cx, cy in inner_cells(state, level, r).collect():  # MOST at most
            if 0 <= cx < 1 << level and 0 <= cy < 1 << level:
                found[cx, cy] = True
        return found.ravel()

    front = np.ones(1, bool)
    for level in range(r.bits):
        leaves = front & ~inner(level)
        if leaves.any():
            found = write_and_reread(conflicts(_rows_in(dealt, leaves, level, r)), "refine-found")
            if not found.isEmpty():
                new = extra_points(found, r).distinct().join(state.select("x", "y"), ["x", "y"], "left_anti")
                state = write_and_reread(state.unionByName(new.withColumn("level", F.lit(level))), "refine-points")
        opened = inner(level)
        leaves = front & ~opened
        if leaves.any():
            done.append(_rows_in(dealt, leaves, level, r).groupBy(*CELL).agg(labels))
        front = (front & opened).reshape((1 << level,) * 2).repeat(2, 0).repeat(2, 1).ravel()
    if front.any():
        pairs = octree._label_pairs(dealt, o)
        units = (pairs if many else pairs.distinct()).groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("int").alias("n_labels"))
        cx, cy = np.divmod(np.flatnonzero(front), 1 << r.bits)
        held = segs.sparkSession.createDataFrame(pa.table({"cx": cx, "cy": cy}))
        done.append(units.join(F.broadcast(held), ["cx", "cy"], "left_semi").select(F.lit(r.bits).alias("level"), "cx", "cy", "n_labels"))
    cells = done[0]
    for part in done[1:]:
        cells = cells.unionByName(part)
    return state, write_and_reread(cells, "refine-cells")


def _refine_by_fronts(points: DataFrame, segs: DataFrame, r: Resolution) -> tuple[DataFrame, DataFrame]:
    """``refine`` with each level's (cell, segment) rows written: of fractions, or where a level's cells are too many for the driver."""
    o = OctreeOptions(max_level=r.bits, width=r.width)
    zero = F.lit(0).cast("long")
    front = write_and_reread(segs.select(F.lit(0).alias("level"), zero.alias("cx"), zero.alias("cy"), "*").filter(overlap(o)), "refine-front")
    state, done = _given(points), []
    labels = F.count_distinct("label").cast("int").alias("n_labels")
    for level in range(r.bits + 1):
        if level == r.bits:
            done.append(front.groupBy(*CELL).agg(labels))
            break
        leaves = front.join(inner_cells(state, level, r), CELL, "left_anti")
        found = write_and_reread(conflicts(leaves), "refine-found")
        if not found.isEmpty():
            new = extra_points(found, r).distinct().join(state.select("x", "y"), ["x", "y"], "left_anti")
            state = write_and_reread(state.unionByName(new.withColumn("level", F.lit(level))), "refine-points")
        inner = inner_cells(state, level, r)
        done.append(front.join(inner, CELL, "left_anti").groupBy(*CELL).agg(labels))
        front = write_and_reread(children(front.join(inner, CELL, "left_semi"), 2).filter(overlap(o)), "refine-front")
        if front.isEmpty():
            break
    cells = done[0]
    for part in done[1:]:
        cells = cells.unionByName(part)
    return state, write_and_reread(cells, "refine-cells")
