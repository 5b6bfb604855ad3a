"""Extraction of the generalised Voronoi diagram: points and lines in the plane, surfaces in space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import geom, vec
from lattica.operators.octree import OctreeOptions


def edge_points(edges: DataFrame, nearest: DataFrame, dim: int = 2) -> DataFrame:
    """(x, y[, z], axis, len, la, lb, qx, qy[, qz]): on each edge whose ends have different labels, where both closest points are equally far.

    nearest: x, y[, z], label, px, py[, pz]. Where no such point exists the middle is taken.
    """
    axes = "xyz"[:dim]
    step = lambda value: [F.col(a) + F.when(F.col("axis") == i, value).otherwise(0) for i, a in enumerate(axes)]
    at = nearest.select(*axes, F.col("label").alias("la"), *[F.col(f"p{a}").alias(f"a{a}") for a in axes])
    both = edges.join(at, list(axes)).select("*", *[c.alias(f"far_{a}") for a, c in zip(axes, step(F.col("len")), strict=True)])
    far = nearest.select(*[F.col(a).alias(f"far_{a}") for a in axes], F.col("label").alias("lb"), *[F.col(f"p{a}").alias(f"b{a}") for a in axes])
    both = both.join(far, [f"far_{a}" for a in axes]).filter("la <> lb")
    s = geom.bisector_on_edge(vec.point("", dim), F.col("len"), F.col("axis"), vec.point("a", dim), vec.point("b", dim))
    both = both.withColumn("s", F.coalesce(s, F.col("len") / 2))
    return both.select(*axes, "axis", "len", "la", "lb", *[c.cast("double").alias(f"q{a}") for a, c in zip(axes, step(F.col("s")), strict=True)])


CELL = ["level", "cx", "cy", "cz"]
FACE = ["normal", "fx", "fy", "fz", "w"]


def shared_faces(leaves: DataFrame, o: OctreeOptions) -> DataFrame:
    """(normal, fx, fy, fz, w, p, q): each face that two leaves share, named by its low corner, as wide as the finer leaf's.

    Every leaf looks up the cell beyond each of its six sides at its own and coarser levels,
    an equi-join of at most one match a side; p is the finer (or equal) leaf and q the other.
    """
    side = F.call_function("shiftright", F.lit(o.width).cast("long"), F.col("level").cast("int"))
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("normal"), F.lit(s).alias("s")) for n in range(3) for s in (-1, 1)]))
    near = leaves.select(*CELL).withColumn("_f", sides).select(*CELL, "_f.normal", "_f.s")
    beyond = [(F.col(f"c{a}") + F.when(F.col("normal") == i, F.col("s")).otherwise(0)) for i, a in enumerate("xyz")]
    near = near.select("*", *[c.alias(f"n{a}") for a, c in zip("xyz", beyond, strict=True)]).withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level"))))
    near = near.filter("up > 0 or s > 0").filter(" and ".join(f"n{a} >= 0" for a in "xyz"))
    corner = [((F.col(f"c{a}") + F.when((F.col("normal") == i) & (F.col("s") > 0), 1).otherwise(0)) * side).alias(f"f{a}") for i, a in enumerate("xyz")]
    look = near.select("normal", *corner, side.alias("w"), F.struct(*CELL).alias("p"), (F.col("level") - F.col("up")).alias("level"), *[F.call_function("shiftright", F.col(f"n{a}"), F.col("up").cast("int")).alias(f"c{a}") for a in "xyz"])
    return look.join(leaves.select(*CELL), CELL).select(*FACE, "p", F.struct(*CELL).alias("q"))


def face_rims(points: DataFrame, leaves: DataFrame, o: OctreeOptions) -> DataFrame:
    """FACE, p, q and the point's columns: the points on the rim of each face that two leaves share, found by the keys of the faces that an edge can bound."""
    widths = F.explode(F.array(*[F.lit(o.width >> k).cast("long") for k in range(o.max_level + 1)]))
    near = points.withColumn("w", widths).filter("len <= w")
    parts = None
    for i, a in enumerate("xyz"):
        for n, m in ((j, 3 - i - j) for j in range(3) if j != i):  # the face's normal, and its other axis
            b = "xyz"[m]
            rows = near.filter(F.col("axis") == i).filter(F.pmod(b, "w") == 0)
            at = {a: F.col(a) - F.pmod(a, "w"), "xyz"[n]: F.col("xyz"[n]), b: F.explode(F.array(F.col(b), F.col(b) - F.col("w")))}
            part = rows.select("x", "y", "z", "axis", "la", "lb", "qx", "qy", "qz", F.lit(n).alias("normal"), "w", *[at[c].alias(f"f{c}") for c in "xyz"])
            parts = part if parts is None else parts.unionByName(part)
    return parts.join(shared_faces(leaves, o), FACE)


def face_fragments(points: DataFrame, leaves: DataFrame, o: OctreeOptions) -> DataFrame:
    """(face, p, q, la, lb, ax.. bx.., rx, ry, rz): the lines in which surfaces between labels cut the shared faces.

    The points on a face's rim give one line if they are two and else a star around their
    mean. la is the label at the lattice vertex r beside the line's first point.
    """
    held = face_rims(points, leaves, o)
    face = Window.partitionBy(*FACE)
    order = face.orderBy("x", "y", "z", "axis")
    held = held.withColumn("n", F.count(F.lit(1)).over(face)).withColumn("turn", F.row_number().over(order))
    for c in "xyz":
        held = held.withColumn(f"m{c}", F.avg(f"q{c}").over(face)).withColumn(f"l{c}", F.lead(f"q{c}").over(order))
    lines = held.filter("n > 2 or (n = 2 and turn = 1)")
    two = F.col("n") == 2
    ends = [F.col(f"q{c}").alias(f"a{c}") for c in "xyz"] + [F.when(two, F.col(f"l{c}")).otherwise(F.col(f"m{c}")).alias(f"b{c}") for c in "xyz"]
    return lines.select(*FACE, "p", "q", "la", "lb", *ends, *[F.col(c).alias(f"r{c}") for c in "xyz"]).filter("ax <> bx or ay <> by or az <> bz")


def cell_triangles(fragments: DataFrame) -> DataFrame:
    """(label, other, level, cx, cy, cz, ax.. bx.. tx..): the surface of each label against another, cell by cell.

    A triangle joins a line on the cell's side to the mean of the cell's distinct points. It is
    given once for each label of its pair, wound so that its normal points out of the label's region.
    """
    both = fragments.withColumn("cell", F.explode(F.array("p", "q"))).select("cell.*", *[c for c in fragments.columns if c not in ("p", "q")])
    ends = both.select(*CELL, F.explode(F.array(*[F.struct(*[F.col(e + c).alias(c) for c in "xyz"]) for e in "ab"])).alias("e")).select(*CELL, "e.*").distinct()
    centres = ends.groupBy(*CELL).agg(*[F.avg(c).alias(f"t{c}") for c in "xyz"])
    made = both.join(centres, CELL)
    a, b, t, r = (vec.point(p, 3) for p in "abtr")
    out = vec.dot(geom.triangle_normal(a, b, t), vec.sub(r, a)) > 1e-3  # toward la's side, beyond what rounding can do
    sides = F.explode(F.array(F.struct(F.col("la").alias("label"), F.col("lb").alias("other"), out.alias("swap")), F.struct(F.col("lb").alias("label"), F.col("la").alias("other"), (~out).alias("swap"))))
    made = made.withColumn("_s", sides).select("*", "_s.*")
    turned = lambda one, two, c: F.when(F.col("swap"), F.col(two + c)).otherwise(F.col(one + c))
    return made.select("label", "other", *CELL, *[turned("a", "b", c).alias(f"a{c}") for c in "xyz"], *[turned("b", "a", c).alias(f"b{c}") for c in "xyz"], *[f"t{c}" for c in "xyz"])


def cell_lines(points: DataFrame, leaves: DataFrame, o: OctreeOptions) -> DataFrame:
    """(level, cx, cy, la, lb, qx, qy, mx, my): lines from each point on a cell's sides to the mean of the cell's points."""
    side = F.call_function("shiftright", F.lit(o.width).cast("long"), F.col("level").cast("int"))
    near = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(o.max_level))))
    along = lambda c: F.array(F.floor(F.col(c) / side))
    across = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / side), F.ceil(F.col(c) / side) - 1))
    near = near.withColumn("cx", F.explode(F.when(F.col("axis") == 0, along("x")).otherwise(across("x")).cast("array<bigint>")))
    near = near.withColumn("cy", F.explode(F.when(F.col("axis") == 1, along("y")).otherwise(across("y")).cast("array<bigint>")))
    near = near.filter("len <= " + f"shiftright({o.width}L, cast(level as int))")
    held = near.join(leaves.select("level", "cx", "cy"), ["level", "cx", "cy"])
    cell = Window.partitionBy("level", "cx", "cy")
    return held.select("level", "cx", "cy", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"), "qx", "qy", F.avg("qx").over(cell).alias("mx"), F.avg("qy").over(cell).alias("my"))


def mean_values(corners: DataFrame, polygon: list[str], order: list[str], at: vec.Point) -> DataFrame:
    """(polygon, value): mean value interpolation of the corners' values (x, y, value) at a point.

    At a corner the value is that corner's, and on a side that is parallel to an axis it is
    interpolated along the side.
    """
    line, whole = Window.partitionBy(*polygon).orderBy(*order), Window.partitionBy(*polygon).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = corners.select(*polygon, *order, "x", "y", "value", *[F.coalesce(F.lag(c).over(line), F.last(c).over(whole)).alias(f"h{c}") for c in "xy"], *[F.coalesce(F.lead(c).over(line), F.first(c).over(whole)).alias(f"j{c}") for c in ("x", "y", "value")])
    own, before, after = (vec.sub((F.col(f"{p}x"), F.col(f"{p}y")), at) for p in ("", "h", "j"))
    size = lambda p: F.nullif(vec.length(p), F.lit(0.0))
    half = lambda p, q: F.tan(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot(p, q) / (size(p) * size(q))))) / 2)
    weight = (half(own, before) + half(own, after)) / size(own)
    side = F.lit(False)
    for k in (0, 1):
        side = side | ((own[k] == 0) & (after[k] == 0) & (own[1 - k] < 0) & (after[1 - k] > 0))
    share = vec.length(own) / size(vec.sub(after, own))
    exact = F.when((own[0] == 0) & (own[1] == 0), F.col("value")).when(side, (1 - share) * F.col("value") + share * F.col("jvalue"))
    rated = ring.select(*polygon, weight.alias("w"), "value", exact.alias("exact"))
    return rated.groupBy(*polygon).agg(F.coalesce(F.max("exact"), F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def label_adjacency(points: DataFrame) -> DataFrame:
    """(a, b, n): pairs of labels that meet, a < b."""
    return points.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def pair_attributes(faces: DataFrame, exponent: int = 128) -> DataFrame:
    """(a, b, nx, ny, nz, area): direction and area of each label pair's faces.

    A face weighs (1 - (dist - min) / range) ** exponent within its pair, or 1 if the pair
    has a single distance.
    """
    pair = Window.partitionBy("a", "b")
    low, high = F.min("dist").over(pair), F.max("dist").over(pair)
    weighed = faces.withColumn("w", F.coalesce(F.pow(1 - (F.col("dist") - low) / F.nullif((high - low).cast("double"), F.lit(0.0)), exponent), F.lit(1.0)))
    return weighed.groupBy("a", "b").agg(*[F.sum(F.col("w") * F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"], F.sum("area").alias("area"))


def raster(spark, width: int, pixels: int) -> DataFrame:
    """(x, y) lattice positions of a square raster's pixel corners."""
    step = width // pixels
    axis = spark.range(0, pixels + 1)
    return axis.select((F.col("id") * step).alias("x")).crossJoin(F.broadcast(axis.select((F.col("id") * step).alias("y"))))  # pixels + 1 rows


def normalised(distance2: Column, most: Column) -> Column:
    """Distance relative to the largest, from squared distances."""
    return F.sqrt(distance2) / F.nullif(F.sqrt(most), F.lit(0.0))


def leaf_field(pixels: DataFrame, leaves: DataFrame, values: DataFrame, o: OctreeOptions) -> DataFrame:
    """(x, y[, z], level, field): values of lattice vertices (x, y[, z], value), interpolated inside the leaf of each pixel from its corners.

    A pixel looks up the cell that holds it at every level, an equi-join that finds its one
    leaf; the far sides of the lattice belong to the last cells. A corner's weight is the product over axes of the
    pixel's nearness to it. A pixel outside the lattice, or in a leaf of which a corner has no value, has
    no row; pixels that repeat a place count once.
    """
    axes = list("xyz"[: o.dim])
    cell = ["level", *[f"c{a}" for a in axes]]
    side = F.call_function("shiftright", F.lit(o.width).cast("long"), F.col("level").cast("int"))
    inside = geom.in_closed(vec.point("", o.dim), (F.lit(0),) * o.dim, (F.lit(o.width),) * o.dim)
    near = pixels.select(*axes).distinct().filter(inside).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(o.max_level))))
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1
    near = near.select("*", *[F.least(F.floor(F.col(a) / side), last).cast("long").alias(f"c{a}") for a in axes])
    held = near.join(leaves.select(*cell), cell).withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit((1 << o.dim) - 1))))
    bit = lambda i: F.shiftright("corner", i).bitwiseAND(F.lit(1))
    weight = F.lit(1.0)
    for i, a in enumerate(axes):
        share = (F.col(a) - F.col(f"c{a}") * side) / side
        weight = weight * F.when(bit(i) == 1, share).otherwise(1 - share)
    spots = held.select(*axes, "level", weight.alias("_w"), *[((F.col(f"c{a}") + bit(i)) * side).alias(f"_{a}") for i, a in enumerate(axes)])
    valued = spots.join(values.select(*[F.col(a).alias(f"_{a}") for a in axes], "value"), [f"_{a}" for a in axes])
    return valued.groupBy(*axes, "level").agg(F.sum(F.col("_w") * F.col("value")).alias("field"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 1 << o.dim).drop("_n")
