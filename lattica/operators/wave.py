"""Distance transform on the leaf lattice: seeds, relaxation, and cell ambiguity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from lattica.functions import geom, planes, solids, vec
from lattica.operators.graph import connected_components
from lattica.operators.octree import OctreeOptions, children, incident_cells, leaf_edges, leaf_vertices, split_leaves
from lattica.session import scratched, write_and_reread


#: Rows of (leaf, primitive) whose seeds are folded together within a task, and the widest lattice for that.
ROWS, WIDEST = 1 << 16, 1 << 20


def _nearer(rows: pa.RecordBatch, o: OctreeOptions) -> pa.RecordBatch:
    """(x, y[, z], label, px, py[, pz], d2): the least of the rows' seeds for each corner."""
    axes, many = "xyz"[: o.dim], 1 << o.dim
    row, corner = np.repeat(np.arange(rows.num_rows), many), np.tile(np.arange(many), rows.num_rows)
    level, *cell = solids.numbers(rows, ["level", *[f"c{a}" for a in axes]])
    side = np.int64(o.width) >> level[row]
    at = [(c[row] + (corner >> j & 1)) * side for j, c in enumerate(cell)]
    if o.dim == 2:
        ends = [c[row] for c in planes.ends(rows)]
        near = solids.foot_on_segment(at, ends[:2], ends[2:])
    else:
        near = solids.foot(at, solids.taken(solids.corners(rows), row))
    near = [np.floor(c + 0.5).astype(np.int64) for c in near]
    d2 = sum((c - q) * (c - q) for c, q in zip(at, near, strict=True))
    spot = at[0]
    for c in at[1:]:
        spot = spot * (o.width + 1) + c
    _, spot = np.unique(spot, return_inverse=True)
    best = np.full(spot.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, spot, d2)
    keep = np.flatnonzero(d2 == best[spot])
    held = rows.column("label").dictionary_encode(null_encoding="encode")
    rank = np.empty(len(held.dictionary), np.int64)
    rank[pc.array_sort_indices(held.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(rank))
    label = rank[held.indices.to_numpy(zero_copy_only=False)[row[keep]]]
    order = keep[np.lexsort([*[c[keep] for c in near[::-1]], label, spot[keep]])]
    order = order[np.unique(spot[order], return_index=True)[1]]
    return pa.RecordBatch.from_arrays([*[pa.array(c[order]) for c in at], rows.column("label").take(pa.array(row[order])), *[pa.array(c[order]) for c in near], pa.array(d2[order])], [*axes, "label", *[f"p{a}" for a in axes], "d2"])


def _seeds_at_once(bridge: DataFrame, o: OctreeOptions) -> DataFrame:
    """(x, y[, z], label, px, py[, pz], d2): seeds worked out as arrays, the least of each corner among ROWS rows of a task."""
    axes, most = "xyz"[: o.dim], ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= most:
                yield _nearer(pa.Table.from_batches(held).combine_chunks().to_batches()[0], o)
                held, n = [], 0
        if n:
            yield _nearer(pa.Table.from_batches(held).combine_chunks().to_batches()[0], o)

    long = lambda names: [StructField(c, LongType()) for c in names]
    schema = StructType([*long(axes), bridge.schema["label"], *long(f"p{a}" for a in axes), *long(["d2"])])
    ends = planes.ENDS if o.dim == 2 else solids.CORNERS
    return bridge.select("level", *[f"c{a}" for a in axes], "label", *ends).mapInArrow(run, schema)


def seeds(bridge: DataFrame, o: OctreeOptions) -> DataFrame:
    """(x, y[, z], px, py[, pz], label, d2): for each corner of a leaf with primitives, the nearest point of the leaf's own ones.

    A vertex of several leaves takes the least distance; ties go to the smaller label, then point.
    Points are rounded half up to the lattice and d2 is the exact squared distance to them. Primitives of whole
    coordinates are worked out as arrays and folded before they move; of fractions, as columns.
    """
    axes = "xyz"[: o.dim]
    ends = planes.ENDS if o.dim == 2 else solids.CORNERS
    if o.width <= WIDEST and all(isinstance(bridge.schema[c].dataType, IntegralType) for c in ends):
        found = _seeds_at_once(bridge, o)
    else:
        found = _seeds(bridge, o)
    best = found.groupBy(*axes).agg(F.min(F.struct("d2", "label", *[f"p{a}" for a in axes])).alias("s"))
    return best.select(*axes, *[f"s.p{a}" for a in axes], "s.label", "s.d2")


def _seeds(bridge: DataFrame, o: OctreeOptions) -> DataFrame:
    axes = "xyz"[: o.dim]
    side = F.call_function("shiftright", F.lit(o.width).cast("long"), F.col("level").cast("int"))
    corners = bridge.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit((1 << o.dim) - 1))))
    for j, a in enumerate(axes):
        corners = corners.withColumn(a, (F.col(f"c{a}") + F.shiftright("corner", j).bitwiseAND(F.lit(1))) * side)
    at = vec.point("", o.dim)
    if o.dim == 2:
        near = geom.closest_on_segment(at, vec.point("a", 2), vec.point("b", 2))
    else:
        corners = geom.closest_on_triangle(corners, at, *(vec.point(p, 3) for p in "abt"), "foot")
        near = vec.point("foot", 3)
    found = corners.select(*axes, "label", *[vec.round_half_up(c).cast("long").alias(f"p{a}") for a, c in zip(axes, near, strict=True)])
    return found.withColumn("d2", vec.length2(vec.sub(at, vec.point("p", o.dim))))


def _far_end(axes: str, name: str) -> list[Column]:
    """Columns of the other end of an edge row (x, y[, z], axis, len)."""
    return [(F.col(a) + F.when(F.col("axis") == i, F.col("len")).otherwise(0)).alias(name + a) for i, a in enumerate(axes)]


@scratched
def relax(start: DataFrame, vertices: DataFrame, edges: DataFrame, dim: int = 2, max_rounds: int | None = None, changed: DataFrame | None = None, touched: list[int] | None = None) -> DataFrame:
    """Closest points spread along edges until nothing improves: (x, y[, z], px.., label, d2) of every reached vertex.

    All vertices take the best offer of their neighbours at once; the order (d2, label,
    px, ..) decides, so the fixpoint does not depend on scheduling. Only vertices that
    changed make offers in the next round. A round passes every point on by an edge, and
    distances only fall, so it ends; ``max_rounds`` is a bound for callers that want one.
    ``changed``: the only vertices that may have something new to offer at first, where the
    others are known to have settled; all by default. Every round adds the number of
    vertices that make offers to ``touched``.
    """
    axes = "xyz"[:dim]
    own = [f"p{a}" for a in axes]
    one = edges.select(*[F.col(a).alias(f"u{a}") for a in axes], *_far_end(axes, ""))
    links = one.unionAll(one.select(*[F.col(a).alias(f"u{a}") for a in axes], *[F.col(f"u{a}").alias(a) for a in axes]))
    links = write_and_reread(links.distinct(), "wave-links")
    state = front = write_and_reread(start.join(vertices.select(*axes), list(axes), "left_semi"), "wave-state")
    if changed is not None:
        front = write_and_reread(state.join(changed.select(*axes).distinct(), list(axes), "left_semi"), "wave-front")
    turn = 0
    while max_rounds is None or turn < max_rounds:
        turn += 1
        if touched is not None:
            touched.append(front.count())
        told = front.select(*[F.col(a).alias(f"u{a}") for a in axes], *own, "label").join(links, [f"u{a}" for a in axes])
        told = told.withColumn("d2", vec.length2(vec.sub(vec.point("", dim), vec.point("p", dim))))
        best = told.groupBy(*axes).agg(F.min(F.struct("d2", "label", *own)).alias("o"))
        held = state.select(*axes, F.struct("d2", "label", *own).alias("own"))
        better = best.join(held, list(axes), "left").filter("own is null or o < own")
        front = write_and_reread(better.select(*axes, *[f"o.{c}" for c in own], "o.label", "o.d2"), "wave-front")
        if front.isEmpty():
            return state
        state = write_and_reread(state.join(front.select(*axes), list(axes), "left_anti").unionByName(front), "wave-state")
    raise RuntimeError(f"the wave did not settle in {max_rounds} rounds")


@scratched
def ambiguous_cells(leaves: DataFrame, incident: DataFrame, labels: DataFrame, edges: DataFrame, o: OctreeOptions) -> DataFrame:
    """Leaves (level, cx, cy[, cz]) whose incident vertices don't fall into one part per label, all parts adjacent.

    Parts are the components of equal labels along the cell's own edges; two labels are
    adjacent if an edge of the cell joins them.
    """
    axes = list("xyz"[: o.dim])
    cell = ["level", *[f"c{a}" for a in axes]]
    named = incident.join(labels.select(*axes, "label"), axes)
    node = F.concat_ws(":", *[F.col(c).cast("string") for c in (*cell, *axes)])
    ends = edges.select(*axes, *_far_end("xyz"[: o.dim], "far_"))
    one = named.select(*cell, *axes, "label", node.alias("u"))
    two = one.select(*cell, *[F.col(a).alias(f"far_{a}") for a in axes], F.col("label").alias("label2"), F.col("u").alias("v"))
    inner = write_and_reread(one.join(ends, axes).join(two, [*cell, *[f"far_{a}" for a in axes]]), "ambiguous-edges")
    parts = connected_components(inner.filter("label = label2").select("u", "v"))
    placed = one.join(parts.withColumnRenamed("node", "u"), "u", "left").withColumn("part", F.coalesce("component", "u"))
    counts = placed.groupBy(*cell).agg(F.count_distinct("part").alias("n_parts"), F.count_distinct("label").alias("n_labels"))
    joined = inner.filter("label <> label2").groupBy(*cell).agg(F.count_distinct(F.least("label", "label2"), F.greatest("label", "label2")).alias("n_pairs"))
    both = counts.join(joined, cell, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return both.filter("n_parts > n_labels or n_pairs < n_labels * (n_labels - 1) div 2").select(*cell, "n_parts", "n_labels", "n_pairs")


def relaxed_labels(leaves: DataFrame, bridge: DataFrame, o: OctreeOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, labels) of a tree: its lattice, and the closest points after relaxation."""
    vertices = write_and_reread(leaf_vertices(leaves, o), "vertices")
    edges = write_and_reread(leaf_edges(vertices, leaves, o), "edges")
    return vertices, edges, relax(seeds(bridge, o), vertices, edges, o.dim)


def split_labels(old: tuple[DataFrame, DataFrame, DataFrame], leaves: DataFrame, bridge: DataFrame, flagged: DataFrame, o: OctreeOptions, touched: list[int] | None = None, local: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, labels) after the flagged leaves were split, from those before.

    leaves, bridge: the tree after the split. Labels known so far stay where nothing better
    comes; the new leaves' seeds join them, and a local front spreads from both ends of every
    new edge and from the vertices that a seed has changed. All other vertices had settled
    over edges that are still there, so a front over the whole lattice (not ``local``) ends the same.
    """
    axes = list("xyz"[: o.dim])
    own = [f"p{a}" for a in axes]
    vertices = write_and_reread(leaf_vertices(leaves, o), "vertices")
    edges = write_and_reread(leaf_edges(vertices, leaves, o), "edges")
    kids = children(flagged.select("level", *[f"c{a}" for a in axes]), o.dim)
    fresh = seeds(bridge.join(kids, kids.columns, "left_semi"), o)
    known = F.struct("d2", "label", *own)
    best = old[2].select(*axes, known.alias("s"), F.lit(False).alias("new")).unionAll(fresh.select(*axes, known.alias("s"), F.lit(True).alias("new")))
    # an old label wins a tie, as it has been offered already
    best = write_and_reread(best.groupBy(*axes).agg(F.min(F.struct("s", "new")).alias("b")).select(*axes, *[F.col(f"b.s.{c}").alias(c) for c in (*own, "label", "d2")], "b.new"), "wave-start")
    changed = None
    if local:
        added = edges.join(old[1], [*axes, "axis", "len"], "left_anti")
        ends = added.select(*axes).unionAll(added.select(*_far_end("".join(axes), "")))
        changed = write_and_reread(ends.unionAll(best.filter("new").select(*axes)).distinct(), "wave-changed")
    return vertices, edges, relax(best.drop("new"), vertices, edges, o.dim, changed=changed, touched=touched)


def subdivide_ambiguous(leaves: DataFrame, bridge: DataFrame, o: OctreeOptions, touched: list[int] | None = None, local: bool = True) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """(leaves, bridge, (vertices, edges, labels)) after ambiguous leaves above the last level are split, until none is left.

    The lattice is relaxed once as a whole; after each round's splits a front spreads from
    the new edges only (``split_labels``). A round splits every ambiguous leaf at once, and a leaf can be
    split ``max_level`` times at most, which bounds the rounds.
    """
    key = ["level", *[f"c{a}" for a in "xyz"[: o.dim]]]
    lattice = relaxed_labels(leaves, bridge, o)
    while True:
        vertices, edges, labels = lattice
        found = ambiguous_cells(leaves, incident_cells(vertices, leaves, o), labels, edges, o)
        flagged = write_and_reread(found.filter(F.col("level") < o.max_level).select(*key), "ambiguous-flagged")
        if flagged.isEmpty():
            return leaves, bridge, lattice
        leaves, bridge = split_leaves(leaves, bridge, flagged, o)
        lattice = split_labels(lattice, leaves, bridge, flagged, o, touched, local)
