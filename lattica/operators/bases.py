"""Which leaves a lattice vertex belongs to, direction by direction, and walks to the next leaf's corner.

A direction is a set of axes, one bit each. The base of a vertex in a direction is the
leaf whose box holds it so that the vertex lies beyond the leaf's low corner on just those
axes. There is one at most, and the base in no direction is the leaf that begins there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.octree import OctreeOptions, incident_cells


def bases(vertices: DataFrame, leaves: DataFrame, o: OctreeOptions) -> DataFrame:
    """(x, y[, z], direction, dist, w, level, cx, cy[, cz]): every vertex with its bases; dist is the sum over axes to the low corner, w the leaf's side."""
    axes = "xyz"[: o.dim]
    side = F.call_function("shiftright", F.lit(o.width).cast("long"), F.col("level").cast("int"))
    off = [F.col(a) - F.col(f"c{a}") * side for a in axes]
    mask = sum((F.when(d > 0, 1 << i).otherwise(0) for i, d in enumerate(off)), F.lit(0))
    return incident_cells(vertices, leaves, o).select(*axes, mask.alias("direction"), sum(off, F.lit(0).cast("long")).alias("dist"), side.alias("w"), "level", *[f"c{a}" for a in axes])


def by_direction(found: DataFrame, o: OctreeOptions) -> DataFrame:
    """(x, y[, z], b0, b1, ..): a row a vertex, its base in each direction as a struct, or null."""
    axes = "xyz"[: o.dim]
    row = F.struct("dist", "w", "level", *[f"c{a}" for a in axes])
    return found.groupBy(*axes).agg(*[F.max(F.when(F.col("direction") == d, row)).alias(f"b{d}") for d in range(1 << o.dim)])


def has_base(direction: int) -> Column:
    return F.col(f"b{direction}").isNotNull()


def on_boundary(axis: int) -> Column:
    """In space: the vertex is on the far side of its base along an axis."""
    return F.coalesce(F.col(f"b{1 << axis}.dist") == F.col(f"b{1 << axis}.w"), F.lit(False))


def within_sides(axis: int) -> Column:
    """In space: across an axis, the vertex is nearer to a base than its far corner, on one of the other axes or on both."""
    one, two = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
    out = F.lit(False)
    for direction, factor in ((one, 1), (two, 1), (one | two, 2)):
        out = out | F.coalesce(F.col(f"b{direction}.dist") < F.col(f"b{direction}.w") * factor, F.lit(False))
    return out


def base_with_fallbacks(normal: int) -> Column:
    """In space: the base along an axis, else along it and one or both of the others; those with one other axis only where the vertex isn't within that axis's sides."""
    n, one, two = 1 << normal, (normal + 1) % 3, (normal + 2) % 3
    first, second = (F.when(~within_sides(a), F.col(f"b{n | 1 << a}")) for a in (one, two))
    return F.coalesce(F.col(f"b{n}"), first, second, F.col(f"b{n | 1 << one | 1 << two}"))


def next_base(vertices: DataFrame, edges: DataFrame, leaves: DataFrame, o: OctreeOptions) -> DataFrame:
    """(x, y[, z], axis, back, ahead): how far each vertex can walk along edges to the next vertex where a leaf begins, either way; null if it comes to none.

    Along a lattice line, runs of vertices that edges join are told apart by a count of the
    gaps before them; a line holds no more vertices than the lattice is wide.
    """
    axes = "xyz"[: o.dim]
    side = F.call_function("shiftright", F.lit(o.width).cast("long"), F.col("level").cast("int"))
    corners = leaves.select(*[(F.col(f"c{a}") * side).alias(a) for a in axes]).distinct().withColumn("_base", F.lit(True))
    marked = vertices.select(*axes).join(corners, list(axes), "left")
    out = None
    for i, a in enumerate(axes):
        rest = [c for c in axes if c != a]
        joined = marked.join(edges.filter(F.col("axis") == i).select(*axes, F.lit(True).alias("_edge")), list(axes), "left")
        line = Window.partitionBy(*rest).orderBy(a)
        # a run ends at a vertex from which no edge goes on
        runs = joined.withColumn("_run", F.coalesce(F.sum(F.when(F.col("_edge").isNull(), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        run = Window.partitionBy(*rest, "_run").orderBy(a)
        place = F.when(F.col("_base"), F.col(a))
        back = F.last(place, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.first(place, ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing))
        part = runs.select(*axes, F.lit(i).alias("axis"), (F.col(a) - back).alias("back"), (ahead - F.col(a)).alias("ahead"))
        out = part if out is None else out.unionByName(part)
    return out
