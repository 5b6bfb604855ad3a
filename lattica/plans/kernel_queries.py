"""Registered queries over the column functions and the small mesh and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import geom, morton, vec, wide
from lattica.operators import fitting, graph, mesh, octree, quantise, spatial, stats
from lattica.plans import oracle, views
from lattica.plans.queries import FINE, SMALL, WIDTH, _codes, _tree, query, reindexed_faces, weld_vertices
from lattica.plans.views import TREE

_L2 = "(x * x + y * y + z * z)"


@query(f"WITH {oracle.POINTS3} SELECT vid, x + y + z AS l1, -x AS neg_x, x < 600 AND y < 600 AND z < 600 AS below, x < 512 OR (x = 512 AND (y < 512 OR (y = 512 AND z < 512))) AS lex, CAST(trunc(x / 3.0) AS INTEGER) AS third, CAST(floor(CAST(CAST(sqrt(CAST({_L2} AS DOUBLE)) AS FLOAT) AS DOUBLE) + 0.5) AS BIGINT) AS len, x * x + y * y + z * z AS len2, CAST(sign(x - 512) AS INTEGER) AS side, (x - 512) // 7 AS seventh, x + 5 AS moved, z AS lifted, CASE WHEN label % 3 = 0 THEN x WHEN label % 3 = 1 THEN y ELSE z END AS picked, CASE WHEN label % 3 = 1 THEN -1 ELSE y END AS set_y, least(x, 500) AS low, greatest(y, 500) AS high, y * 512 - z * 512 AS cross_x, x * 512 AS scaled, x * y AS product FROM p3")
def vector_algebra(spark, sf_dir):
    """Vector functions, each as a column, over every point in space."""
    p, middle = vec.point("", 3), vec.broadcast_scalar(F.lit(512), 3)
    axis = F.col("label") % 3
    return views.points3(spark, sf_dir).select(
        "vid", vec.component_sum(p).alias("l1"), vec.negate(p)[0].alias("neg_x"), vec.all_less(p, 600).alias("below"), vec.lexicographic_less(p, tuple(c.cast("long") for c in middle)).alias("lex"),
        vec.truncate(vec.scale(p, 1 / 3.0))[0].alias("third"), vec.int_length(p).alias("len"), vec.length2(p).alias("len2"), vec.sign(p[0] - 512).alias("side"), vec.int_divide(vec.sub(p, middle), 7)[0].alias("seventh"),
        vec.add(p, vec.broadcast_scalar(F.lit(5), 3))[0].alias("moved"), vec.lift(p[:2], p[2])[2].alias("lifted"), vec.component(p, axis).alias("picked"), vec.with_component(p, axis, F.lit(-1))[1].alias("set_y"),
        vec.least(p, vec.broadcast_scalar(F.lit(500), 3))[0].alias("low"), vec.greatest(p, vec.broadcast_scalar(F.lit(500), 3))[1].alias("high"), vec.cross(p, middle)[0].alias("cross_x"), vec.mul(p, middle)[0].alias("scaled"), vec.mul(p, (p[1], p[2], p[0]))[0].alias("product"),
    )


_BIT = "((i >> {}) & 1)"
_DIR = "d AS (SELECT i, i & 7 AS pos, (i >> 3) & 7 & ~(i & 7) AS neg FROM (SELECT unnest(range(64)) AS i))"


def _digits(pos: str, neg: str) -> str:
    return " + ".join(f"(1 + (({pos} >> {j}) & 1) - (({neg} >> {j}) & 1)) * {3**j}" for j in range(3))


def _slot_masks(index: str, digit: int) -> str:
    return " + ".join(f"CASE WHEN ({index} // {3**j}) % 3 = {digit} THEN {1 << j} ELSE 0 END" for j in range(3))


@query(f"WITH {_DIR}, u AS (SELECT *, pos | 2 AS up, neg | 1 AS down FROM d) SELECT i, neg AS back_pos, pos AS back_neg, up & ~(up & down) AS sum_pos, down & ~(up & down) AS sum_neg, {_digits('pos', 'neg')} AS slot, CAST({_slot_masks('i % 27', 2)} AS BIGINT) AS from_pos, CAST({_slot_masks('i % 27', 0)} AS BIGINT) AS from_neg, i & 7 AS corner_pos, (i & 7) ^ 7 AS corner_neg, CASE WHEN i % 2 = 1 THEN 1 << (i % 3) ELSE 0 END AS axis_pos, CASE WHEN i % 2 = 1 THEN 0 ELSE 1 << (i % 3) END AS axis_neg, (i % 3) * 2 + i % 2 AS cardinal, (i % 3) * 4 + ((i >> 1) & 1) * 2 + (i & 1) AS edge, CASE WHEN (i & 7) & (1 << (i % 3)) <> 0 THEN -1 ELSE (i & 7) + (1 << (i % 3)) END AS next_corner, 64 + 8 * ((i >> 1) & 1) AS corner_y, 64 + 8 * ((pos & 1) - (neg & 1)) AS offset_x, (1 << 25) >> (i % 25) AS width, i % 17 AS level, 64 + (1 << (i % 6)) // 2 AS centre FROM u".replace("(i & 7) ^ 7", "xor(i & 7, 7)"))
def direction_algebra(spark, sf_dir):
    """Directions, corners, edges and cells of the lattice, each function as a column, over all small codes."""
    i = F.col("i").cast("int")
    pos, neg = F.col("pos"), F.col("neg")
    rows = spark.range(64).select(F.col("id").cast("int").alias("i")).select("i", i.bitwiseAND(F.lit(7)).alias("pos"), F.shiftright(i, 3).bitwiseAND(F.lit(7)).bitwiseAND(F.bitwise_not(i.bitwiseAND(F.lit(7)))).alias("neg"))
    back, both = morton.reverse(pos, neg), morton.add_directions(pos, neg, F.lit(2), F.lit(1))
    slot, corner, axis = morton.direction_of_sublattice(i % 27, 3), morton.direction_of_corner(i.bitwiseAND(F.lit(7)), 3), morton.direction_of_axis(i % 3, i % 2 == 1)
    base, eight = (F.lit(64),) * 3, F.lit(8)
    bit = lambda k: F.shiftright(i, k).bitwiseAND(F.lit(1)) == 1
    width = F.call_function("shiftleft", F.lit(1), i % 6)
    made = {"back_pos": back[0], "back_neg": back[1], "sum_pos": both[0], "sum_neg": both[1], "slot": morton.sublattice_index(pos, neg, 3), "from_pos": slot[0], "from_neg": slot[1], "corner_pos": corner[0], "corner_neg": corner[1], "axis_pos": axis[0], "axis_neg": axis[1], "cardinal": morton.cardinal_index(i % 3, bit(0)), "edge": morton.edge_index(i % 3, bit(1), bit(0)), "next_corner": morton.positive_neighbour_corner(i.bitwiseAND(F.lit(7)), i % 3), "corner_y": morton.corner(base, i.bitwiseAND(F.lit(7)), eight)[1], "offset_x": morton.offset(base, pos, neg, eight)[0], "width": morton.level_width(i % 25), "level": morton.level_of_width(F.call_function("shiftright", F.lit(1 << 16), i % 17), 1 << 16), "centre": morton.cell_centre(base, width)[0]}
    return rows.select(F.col("i").cast("long").alias("i"), *[c.cast("long").alias(n) for n, c in made.items()])


@query(f"WITH {oracle.codes(1 << 16)}, led AS (SELECT z, lead(z) OVER (ORDER BY z) AS z_next FROM codes), l AS (SELECT z, CAST(32 - length(bin(xor(z, z_next))) AS INTEGER) AS lcp FROM led WHERE z_next IS NOT NULL) SELECT z, z >> (32 - lcp) AS top, 32 AS code_bits, CAST(4294967296 AS BIGINT) AS volume FROM l")
def lcp_values(spark, sf_dir):
    """The leading bits that each code shares with the next, and the lattice's figures."""
    rows = stats.next_in_order(_codes(spark, sf_dir, FINE), "z", F.shiftright("z", 24), "z_next").filter("z_next is not null")
    return rows.select("z", morton.lcp_value(F.col("z"), morton.lcp_length(F.col("z"), F.col("z_next"), FINE), FINE).alias("top"), F.lit(FINE.code_bits).alias("code_bits"), F.lit(FINE.volume).cast("long").alias("volume"))


_WIDE = "w AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 1000000007 + o_custkey AS a, CAST(o_custkey AS HUGEINT) + 998244353 AS b FROM orders)"


@query(f"WITH {_WIDE} SELECT o_orderkey, CAST(a * b AS VARCHAR) AS product, CAST((a * b) // (b + 12345) AS VARCHAR) AS quotient, CAST((a * b) % (b + 12345) AS VARCHAR) AS rest, CAST(b - a * b AS VARCHAR) AS difference, CAST(a * b + a AS VARCHAR) AS total, a * b > 1000000000000000000 AS above, CAST(-((a * b) // 7) AS VARCHAR) AS negative, CAST(-((a * b) % 7) AS VARCHAR) AS negative_rest FROM w")
def wide_integers(spark, sf_dir):
    """Products, quotients and signs of whole numbers beyond 64 bits."""
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.lit(1_000_000_007).cast("long") + F.col("o_custkey")).alias("a"), (F.col("o_custkey") + 998_244_353).alias("b"))
    product = wide.multiply(F.col("a"), F.col("b"))
    by = wide.wide(F.col("b") + 12345)
    quotient, rest = wide.divide(product, by)
    negative = wide.divide(wide.subtract(wide.wide(F.lit(0)), product), wide.wide(F.lit(7)))
    text = lambda c: c.cast("string")
    return rows.select("o_orderkey", text(product).alias("product"), text(quotient).alias("quotient"), text(rest).alias("rest"), text(wide.subtract(wide.wide(F.col("b")), product)).alias("difference"), text(wide.add(product, wide.wide(F.col("a")))).alias("total"), (product > 10**18).alias("above"), text(negative[0]).alias("negative"), text(negative[1]).alias("negative_rest"))


_PAIR = f"{oracle.SEGMENTS}, pair AS (SELECT label, ord, ax, ay, bx, by_, lead(ax, 2) OVER w AS cx, lead(ay, 2) OVER w AS cy, lead(bx, 2) OVER w AS dx, lead(by_, 2) OVER w AS dy FROM seg WINDOW w AS (PARTITION BY label ORDER BY ord)), k AS (SELECT *, CAST((bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS DOUBLE) AS det, sqrt(CAST((by_ - ay) * (by_ - ay) + (bx - ax) * (bx - ax) AS DOUBLE)) AS l FROM pair WHERE cx IS NOT NULL)"
_SIDES = "(bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) = 0 AND (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) = 0"
_BOXES = "least(ax, bx) <= greatest(cx, dx) AND least(cx, dx) <= greatest(ax, bx) AND least(ay, by_) <= greatest(cy, dy) AND least(cy, dy) <= greatest(ay, by_)"


def _end_distance(px: str, py: str, ux: str, uy: str, vx: str, vy: str) -> str:
    n = f"nullif(CAST(({vx} - {ux}) * ({vx} - {ux}) + ({vy} - {uy}) * ({vy} - {uy}) AS DOUBLE), 0.0)"
    t = f"coalesce(greatest(0.0, least(1.0, (({px} - {ux}) * ({vx} - {ux}) + ({py} - {uy}) * ({vy} - {uy})) / {n})), 0.0)"
    return f"(({px} - ({ux} + {t} * ({vx} - {ux}))) ** 2 + ({py} - ({uy} + {t} * ({vy} - {uy}))) ** 2)"


_A, _B, _C, _D = (("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy"))
_ORIENT = lambda p, q, r: f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
_CROSS = f"({_ORIENT(_A, _B, _C)} * {_ORIENT(_A, _B, _D)} < 0 AND {_ORIENT(_C, _D, _A)} * {_ORIENT(_C, _D, _B)} < 0)"
_GAP = f"CASE WHEN {_CROSS} THEN 0.0 ELSE least({', '.join(_end_distance(*p, *u, *v) for p, u, v in ((_A, _C, _D), (_B, _C, _D), (_C, _A, _B), (_D, _A, _B)))}) END"
_CLIP = {}
for _axis, (_p, _q) in (("x", ("ax", "bx")), ("y", ("ay", "by_"))):
    _d = f"nullif(CAST({_q} - {_p} AS DOUBLE), 0.0)"
    _CLIP[_axis] = (f"coalesce(least((1024 - {_p}) / {_d}, (3072 - {_p}) / {_d}), 0.0)", f"coalesce(greatest((1024 - {_p}) / {_d}, (3072 - {_p}) / {_d}), 1.0)", f"({_p} <> {_q} OR ({_p} >= 1024 AND {_p} <= 3072))")
_ENTER = f"greatest(0.0, {_CLIP['x'][0]}, {_CLIP['y'][0]})"
_LEAVE = f"least(1.0, {_CLIP['x'][1]}, {_CLIP['y'][1]})"


@query(f"WITH {_PAIR} SELECT label, ord, round(ax + ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif(det, 0.0) * (bx - ax), 3) AS meet_x, {_SIDES} AND {_BOXES} AS on_line, round(ax + (bx - ax) * (2048 - ay) / nullif(CAST(by_ - ay AS DOUBLE), 0.0), 3) AS x_at, round(ay + (by_ - ay) * (2048 - ax) / nullif(CAST(bx - ax AS DOUBLE), 0.0), 3) AS y_at, (ay + by_) / 2 AS mid_y, CASE WHEN ax < 1024 THEN 1 ELSE 0 END + CASE WHEN ax > 3072 THEN 2 ELSE 0 END + CASE WHEN ay < 1024 THEN 4 ELSE 0 END + CASE WHEN ay > 3072 THEN 8 ELSE 0 END AS code, abs(ay - by_) < 64 AS near, least(ay, by_) <= greatest(cy, dy) AND least(cy, dy) <= greatest(ay, by_) AS beside, greatest(ax, bx) - least(ax, bx) = greatest(ay, by_) - least(ay, by_) AS square, {_SIDES} AS parallel, round({_GAP}, 3) AS gap2, CASE WHEN {_CLIP['x'][2]} AND {_CLIP['y'][2]} AND {_ENTER} <= {_LEAVE} THEN round(ay + {_ENTER} * (by_ - ay), 3) END AS enter_y, round(-(by_ - ay) / nullif(l, 0.0), 6) AS normal_x, round((-(by_ - ay) / nullif(l, 0.0)) * ax + ((bx - ax) / nullif(l, 0.0)) * ay, 3) AS reach FROM k")
def line_kernels(spark, sf_dir):
    """Functions on pairs of segments and on segments and a box, each as a column."""
    a, b, c, d = (vec.point(p, 2) for p in "abcd")
    low, high = (F.lit(1024), F.lit(1024)), (F.lit(3072), F.lit(3072))
    normal, least, _ = geom.segment_axis(a, b)
    pairs = fitting.neighbour_pairs(views.segments(spark, sf_dir))
    third = lambda x: F.round(x.cast("double"), 3)
    span = lambda p, q: (F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    return pairs.select(
        "label", "ord", third(geom.line_intersection(a, b, c, d)[0]).alias("meet_x"), geom.collinear_overlap(a, b, c, d).alias("on_line"), third(geom.x_at(a, b, F.lit(2048))).alias("x_at"), third(geom.y_at(a, b, F.lit(2048))).alias("y_at"),
        geom.midpoint(a, b)[1].alias("mid_y"), geom.outcode(a, 1024, 3072).alias("code"), geom.within(a[1], b[1], 64).alias("near"), geom.intervals_overlap(*span(a, b), *span(c, d)).alias("beside"), geom.is_square(vec.least(a, b), vec.greatest(a, b)).alias("square"),
        ((geom.orientation(a, b, c) == 0) & (geom.orientation(a, b, d) == 0)).alias("parallel"), third(geom.segment_distance2(a, b, c, d)).alias("gap2"), third(geom.clip_start(a, b, low, high)[1]).alias("enter_y"), F.round(normal[0], 6).alias("normal_x"), third(vec.dot(normal, a)).alias("reach"),
    )


@query(f"WITH {oracle.TRIS} SELECT prim_id, 1 AS slot, c AS next, a AS before, c AS ahead, a AS opposite_from, c AS opposite_to, true AS has_edge, false AS has_other, array_to_string(list_sort([a, b, c]), ',') AS ids, true AS turned_same, false AS inverted_same, c AS inverted_a FROM tri")
def triangle_kernels(spark, sf_dir):
    """Cyclic helpers on every triangle, asked for its middle vertex."""
    b = F.col("b")
    opposite = mesh.triangle_opposite(b)
    tris = views.triangles(spark, sf_dir).select("prim_id", "a", "b", "c")
    rows = tris.join(mesh.invert(tris).select("prim_id", F.col("a").alias("ia"), F.col("b").alias("ib"), F.col("c").alias("ic")), "prim_id")
    return rows.select("prim_id", mesh.triangle_slot(b).alias("slot"), mesh.triangle_step(b, 1).alias("next"), mesh.triangle_step(b, 2).alias("before"), mesh.triangle_vertex(F.lit(2)).alias("ahead"), opposite[0].alias("opposite_from"), opposite[1].alias("opposite_to"), mesh.triangle_has_edge(F.col("c"), F.col("a")).alias("has_edge"), mesh.triangle_has_edge(F.col("a"), F.lit(-1)).alias("has_other"), F.array_join(mesh.triangle_key().cast("array<string>"), ",").alias("ids"), mesh.same_winding((F.col("b"), F.col("c"), F.col("a"))).alias("turned_same"), mesh.same_winding((F.col("ia"), F.col("ib"), F.col("ic"))).alias("inverted_same"), F.col("ia").alias("inverted_a"))


@query(f"WITH {oracle.POINTS}, box AS (SELECT min(fx) AS x0, min(fy) AS y0, greatest(max(fx) - min(fx), max(fy) - min(fy)) AS ext FROM points2) SELECT fx, fy, label, round((fx - x0) / ext * 4096, 4) AS ox, round((fy - y0) / ext * 4096, 4) AS oy, round(((fy - y0) / ext * 4096) / 4096 * ext + y0, 4) AS back_y, round(100 / 4096.0 * ext, 4) AS distance FROM points2, box")
def lattice_transforms(spark, sf_dir):
    """Points and distances from the object's space to the lattice and back."""
    points = views.points2(spark, sf_dir)
    box = quantise.bounding_box(points, ["fx", "fy"]).select(F.col("min_fx").alias("x0"), F.col("min_fy").alias("y0"), F.col("max_size").alias("ext"))
    rows = points.crossJoin(F.broadcast(box))  # one row
    ox, oy = (quantise.object_to_lattice(F.col(f"f{a}"), F.col(f"{a}0"), F.col("ext"), 4096) for a in "xy")
    return rows.select("fx", "fy", "label", F.round(ox, 4).alias("ox"), F.round(oy, 4).alias("oy"), F.round(quantise.lattice_to_object(oy, F.col("y0"), F.col("ext"), 4096), 4).alias("back_y"), F.round(quantise.lattice_to_object(F.lit(100.0), F.lit(0.0), F.col("ext"), 4096), 4).alias("distance"))


@query(f"WITH {oracle.POINTS3} SELECT label, min(x) + 10.0 AS min_x, max(x) + 10.0 AS max_x, min(y) - 5.0 AS min_y, max(z) + 0.5 AS max_z FROM p3 GROUP BY label")
def translated_boxes(spark, sf_dir):
    """Boxes of all labels after a move."""
    moved = mesh.translate(views.points3(spark, sf_dir), (10.0, -5.0, 0.5))
    return quantise.bounding_box(moved, ["x", "y", "z"], ["label"]).select("label", "min_x", "max_x", "min_y", "max_z")


_WELDED = f"{oracle.TRIS}, w AS (SELECT vid, min(vid) OVER (PARTITION BY x // 64, y // 64, z // 64) AS t FROM p3), face AS (SELECT * FROM (SELECT prim_id, p.t AS a, q.t AS b, r.t AS c FROM tri JOIN w p ON p.vid = a JOIN w q ON q.vid = b JOIN w r ON r.vid = c) WHERE a <> b AND b <> c AND a <> c), fedge AS (SELECT prim_id, a AS u, b AS v, c AS o FROM face UNION ALL SELECT prim_id, b, c, a FROM face UNION ALL SELECT prim_id, c, a, b FROM face), fkey AS (SELECT *, least(u, v) AS lo, greatest(u, v) AS hi FROM fedge)"


def _welded(spark, sf_dir):
    """Faces over vertices welded on a grid of 64, without those that have become flat."""
    return reindexed_faces(spark, sf_dir).filter("a <> b and b <> c and a <> c")


@query(f"WITH {_WELDED}, s AS (SELECT vid, min(pos) AS pos FROM (SELECT a AS vid, prim_id * 3 AS pos FROM face UNION ALL SELECT b, prim_id * 3 + 1 FROM face UNION ALL SELECT c, prim_id * 3 + 2 FROM face) GROUP BY vid), m AS (SELECT vid, row_number() OVER (ORDER BY pos) - 1 AS t FROM s) SELECT prim_id, p.t AS a, q.t AS b, r.t AS c FROM face JOIN m p ON p.vid = a JOIN m q ON q.vid = b JOIN m r ON r.vid = c")
def compacted_faces(spark, sf_dir):
    """Welded faces over the used vertices alone, numbered by first use."""
    return mesh.compact(_welded(spark, sf_dir), 256)[0].select("prim_id", "a", "b", "c")


@query(f"WITH {_WELDED} SELECT lo, hi, count(*) AS n FROM fkey GROUP BY lo, hi HAVING count(*) > 2")
def nonmanifold_welded_edges(spark, sf_dir):
    """Edges with more than two triangles after welding."""
    return mesh.nonmanifold_edges(_welded(spark, sf_dir))


@query(f"WITH {oracle.TRIS}, e AS (SELECT prim_id, a AS u, b AS v, c AS o FROM tri UNION ALL SELECT prim_id, b, c, a FROM tri UNION ALL SELECT prim_id, c, a, b FROM tri), k AS (SELECT *, least(u, v) AS lo, greatest(u, v) AS hi FROM e), two AS (SELECT lo, hi FROM k GROUP BY lo, hi HAVING count(*) = 2 AND min(prim_id) <> max(prim_id)) SELECT p.prim_id, p.o AS vid, q.prim_id AS other FROM k p JOIN two USING (lo, hi) JOIN k q ON q.lo = p.lo AND q.hi = p.hi AND q.prim_id <> p.prim_id")
def opposite_triangles(spark, sf_dir):
    """The triangle across from each corner."""
    return mesh.opposite_triangles(views.triangles(spark, sf_dir))


@query(f"WITH {_WELDED}, s AS (SELECT p.prim_id, count(*) AS n FROM fkey p JOIN fkey q ON p.lo = q.lo AND p.hi = q.hi AND p.prim_id <> q.prim_id AND p.u = q.u GROUP BY p.prim_id) SELECT f.prim_id, coalesce(n, 0) AS n, coalesce(n, 0) > 1 AS flip FROM face f LEFT JOIN s USING (prim_id)")
def local_orientation(spark, sf_dir):
    """Triangles that most neighbours run against."""
    return mesh.local_flips(_welded(spark, sf_dir))


@query()
def split_sheets(spark, sf_dir):
    """Welded faces taken apart at edges of more than two triangles; held against its properties in the tests."""
    return mesh.split_sheets(_welded(spark, sf_dir), 256)[0]


_NAME = lambda p, q: f"least({p}, {q}) || '-' || greatest({p}, {q})"


def _iso_sql() -> str:
    good = {c: f"d{c} < 110" for c in "abc"}
    kept = "CAST((da < 110) AS INTEGER) + CAST((db < 110) AS INTEGER) + CAST((dc < 110) AS INTEGER)"
    parts = ["SELECT prim_id, 0 AS piece, a || '-' || a AS p, b || '-' || b AS q, c || '-' || c AS r FROM k WHERE kept = 3"]
    own = lambda v: f"{v} || '-' || {v}"
    for i, j, k in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        parts.append(f"SELECT prim_id, 0, {own(j)}, {own(k)}, {_NAME(k, i)} FROM k WHERE kept = 2 AND NOT {good[i]}")
        parts.append(f"SELECT prim_id, 1, {own(j)}, {_NAME(k, i)}, {_NAME(j, i)} FROM k WHERE kept = 2 AND NOT {good[i]}")
        parts.append(f"SELECT prim_id, 0, {own(i)}, {_NAME(i, j)}, {_NAME(i, k)} FROM k WHERE kept = 1 AND {good[i]}")
    from lattica.plans.queries import _DIST

    return f"WITH {oracle.TRIS}, d AS (SELECT prim_id, a, b, c, {_DIST} FROM tri), k AS (SELECT *, {kept} AS kept FROM d) " + " UNION ALL ".join(parts)


@query(_iso_sql())
def mesh_iso_triangles(spark, sf_dir):
    """The triangles that are left within 110 of the middle, over kept vertices and cut points."""
    from lattica.plans.queries import _valued

    made = mesh.iso_triangles(_valued(spark, sf_dir), 110.0)
    return made.select("prim_id", "piece", *[F.concat_ws("-", F.col(f"{c}.lo").cast("string"), F.col(f"{c}.hi").cast("string")).alias(c) for c in "pqr"])


@query(f"WITH {oracle.tree()}, {oracle.VERTICES}, {oracle.EDGES}, e AS (SELECT x, y, len FROM edge UNION ALL SELECT x + CASE WHEN axis = 0 THEN len ELSE 0 END, y + CASE WHEN axis = 1 THEN len ELSE 0 END, len FROM edge) SELECT x, y, min(len) AS alpha, count(*) AS degree FROM e GROUP BY x, y")
def vertex_alpha(spark, sf_dir):
    """Distance to the nearest neighbour of each lattice vertex, and its number of neighbours."""
    leaves = _tree(spark, sf_dir)[0]
    return octree.neighbour_distance(octree.leaf_edges(octree.leaf_vertices(leaves, TREE), leaves, TREE), TREE)


@query(f"WITH {oracle.SEGMENTS}, v AS (SELECT DISTINCT ax AS x, ay AS y FROM seg UNION SELECT bx, by_ FROM seg), i AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS id FROM v) SELECT DISTINCT least(p.id, q.id) AS u, greatest(p.id, q.id) AS v FROM seg JOIN i p ON p.x = ax AND p.y = ay JOIN i q ON q.x = bx AND q.y = by_ WHERE p.id <> q.id")
def segment_graph(spark, sf_dir):
    """The polylines as one graph over distinct points."""
    return graph.graph_from_segments(views.segments(spark, sf_dir))[1]


@query(f"WITH {oracle.SEGMENTS}, p AS (SELECT label, ord, ax AS x, ay AS y FROM seg), b AS (SELECT label, ord, x, y, (x - 2000) * (x - 2000) + (y - 2100) * (y - 2100) AS d2 FROM p) SELECT * FROM b ORDER BY d2, label, ord LIMIT 1")
def nearest_vertex(spark, sf_dir):
    """The polyline vertex nearest to a picked point."""
    rows = views.segments(spark, sf_dir).select("label", "ord", F.col("ax").alias("x"), F.col("ay").alias("y"))
    return spatial.pick(rows, (F.lit(2000), F.lit(2100)), (F.col("x"), F.col("y")), ["label", "ord"])


_MEAN = f"""{oracle.SEGMENTS}, v AS (SELECT label, ord, ax AS x, ay AS y, lag(ax) OVER o AS hx, lag(ay) OVER o AS hy, bx AS jx, by_ AS jy FROM seg WINDOW o AS (PARTITION BY label ORDER BY ord)),
  r AS (SELECT label, ord, x, y, coalesce(hx, last_value(x) OVER a) AS hx, coalesce(hy, last_value(y) OVER a) AS hy, CASE WHEN ord = max(ord) OVER (PARTITION BY label) THEN first_value(x) OVER a ELSE jx END AS jx, CASE WHEN ord = max(ord) OVER (PARTITION BY label) THEN first_value(y) OVER a ELSE jy END AS jy FROM v WINDOW a AS (PARTITION BY label ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  t AS (SELECT label, ord, sqrt(CAST((x - 2048) * (x - 2048) + (y - 5000) * (y - 5000) AS DOUBLE)) AS d, sqrt(CAST((hx - 2048) * (hx - 2048) + (hy - 5000) * (hy - 5000) AS DOUBLE)) AS dh, sqrt(CAST((jx - 2048) * (jx - 2048) + (jy - 5000) * (jy - 5000) AS DOUBLE)) AS dj, (x - 2048) * (hx - 2048) + (y - 5000) * (hy - 5000) AS ph, (x - 2048) * (jx - 2048) + (y - 5000) * (jy - 5000) AS pj FROM r),
  w AS (SELECT label, ord, (tan(acos(greatest(-1.0, least(1.0, ph / (d * dh)))) / 2) + tan(acos(greatest(-1.0, least(1.0, pj / (d * dj)))) / 2)) / d AS w FROM t)"""


@query(f"WITH {_MEAN} SELECT label, round(sum(w * ord) / sum(w), 4) AS value FROM w GROUP BY label")
def mean_value_field(spark, sf_dir):
    """Mean value interpolation of the vertex numbers of each closed polyline at one point outside the lattice."""
    from lattica.operators import gvd

    corners = views.segments(spark, sf_dir).select("label", "ord", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("ord").cast("double").alias("value"))
    made = gvd.mean_values(corners, ["label"], ["ord"], (F.lit(2048), F.lit(5000)))
    return made.select("label", F.round("value", 4).alias("value"))


@query("SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS n FROM orders GROUP BY o_orderstatus")
def count_flagged(spark, sf_dir):
    """Flagged rows of each group."""
    return stats.count_flagged(views.table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000, ["o_orderstatus"])


@query(f"WITH {oracle.TRIS}, k AS (SELECT label, count(*) AS n FROM tri GROUP BY label) SELECT CAST(sum(2 + 3 * n) + count(*) AS BIGINT) AS size FROM k")
def packed_geometry_size(spark, sf_dir):
    """Words that the geometries of all labels take in packed form: an offset, a head of two, and three a face."""
    return stats.packed_size(views.triangles(spark, sf_dir), "label", 3)


@query(f"WITH {oracle.GRAPH} SELECT u, v, w FROM graph WHERE u < 20 AND w <= 3")
def labels_of_interest(spark, sf_dir):
    """The edges of the first nodes, by a whitelist and a length limit."""
    edges = views.trade_graph(spark, sf_dir)
    wanted = spark.range(20).select(F.col("id").alias("u"))
    return edges.join(F.broadcast(wanted), "u", "left_semi").filter(geom.within(F.col("w"), F.lit(0), 4)).select("u", "v", "w")
