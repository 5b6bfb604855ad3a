"""Golden values, properties and brute-force twins of the geometry operators."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions import geom, morton, pairs, planes, solids, vec
from lattica.functions.morton import Resolution
from lattica.operators import graph, gvd, mesh, octree, quantise, solid, spatial, stats, wave
from lattica.operators.octree import OctreeOptions
from lattica.plans import queries as plans
from lattica.plans import views
from lattica.session import write_and_reread


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lits(*values):
    return tuple(F.lit(v) for v in values)


@pytest.mark.parametrize(("p", "d", "at"), [((1, 0), 0, (1, 0)), ((1, 1), 1, (1, 0)), ((1, -1), 1, (1, 0)), ((-1, 0), 1, (0, 0)), ((3, 0), 1, (2, 0)), ((-1, 1), math.sqrt(2), (0, 0))])
def test_point_segment_distance(spark, p, d, at):
    near = geom.closest_on_segment(lits(*p), lits(0, 0), lits(2, 0))
    got = one(spark, d=F.sqrt(geom.point_segment_distance2(lits(*p), lits(0, 0), lits(2, 0))), x=near[0], y=near[1])
    assert got.d == pytest.approx(d) and (got.x, got.y) == at


def test_vectors(spark):
    p, q = lits(3, 4, 0), lits(1, 0, 2)
    got = one(spark, dot=vec.dot(p, q), length=vec.length(p), rounded=vec.int_length(lits(1, 1)), cross=F.array(*vec.cross(p, q)), low=F.array(*vec.least(p, q)), half=F.array(*vec.int_divide(lits(-7, 7), 2)), less=vec.all_less(p, 5), lex=vec.lexicographic_less(q, p), unit=F.array(*vec.normalize(p)), zero=vec.normalize(lits(0, 0))[0], pick=vec.component(p, F.lit(1)), cut=F.array(*vec.truncate(lits(-1.7, 1.7))), total=vec.component_sum(p))
    assert (got.dot, got.length, got.rounded, got.cross, got.low, got.half) == (3, 5.0, 1, [8, -6, -4], [1, 0, 0], [-3, 3])
    assert got.less and got.lex and got.unit == [0.6, 0.8, 0.0] and got.zero is None and got.pick == 4 and got.cut == [-1, 1] and got.total == 7


def test_morton_and_directions(spark):
    r = Resolution(8, 3)
    z = morton.encode(lits(5, 2, 7), r)
    back = morton.decode(z, r)
    got = one(spark, z=z, back=F.array(*back), lcp=morton.lcp_length(F.lit(12).cast("long"), F.lit(13).cast("long"), r), top=morton.lcp_value(F.lit(511).cast("long"), F.lit(2), r), path=morton.octants(z, F.lit(3), r), width=morton.level_width(F.lit(24)), corner=F.array(*morton.corner(lits(8, 8), F.lit(2), F.lit(4))), moved=F.array(*morton.offset(lits(8, 8), F.lit(1), F.lit(2), F.lit(4))), up=morton.positive_neighbour_corner(F.lit(1), F.lit(1)), end=morton.positive_neighbour_corner(F.lit(1), F.lit(0)), slvi=morton.sublattice_index(F.lit(1), F.lit(2), 2), both=F.array(*morton.add_directions(F.lit(1), F.lit(0), F.lit(2), F.lit(1))))
    want = sum(((v >> i) & 1) << (3 * i + j) for i in range(3) for j, v in enumerate((5, 2, 7)))
    assert (got.z, got.back, got.lcp, got.top) == (want, [5, 2, 7], 8, 3)
    assert got.path == [(want >> s) & 7 for s in (6, 3, 0)] and got.width == 2 and got.corner == [8, 12] and got.moved == [12, 4]
    assert (got.up, got.end, got.slvi, got.both) == (3, -1, 2, [2, 0])
    with pytest.raises(ValueError):
        Resolution(0)


def test_boxes_and_lines(spark):
    low, high = lits(0, 0), lits(4, 4)
    meet = geom.line_intersection(lits(0, 0), lits(4, 4), lits(0, 4), lits(4, 0))
    start = geom.clip_start(lits(-2, 2), lits(2, 2), low, high)
    got = one(spark, open=geom.in_open(lits(0, 2), low, high), half=geom.in_half_open(lits(4, 2), low, high), closed=geom.in_closed(lits(4, 2), low, high), code=geom.outcode(lits(-2, 2)), hit=geom.segment_box_overlap(lits(-1, 1), lits(1, -1), low, high), miss=geom.segment_box_overlap(lits(-2, 1), lits(1, -2), low, high), x=meet[0], y=meet[1], none=geom.line_intersection(lits(0, 0), lits(1, 1), lits(1, 0), lits(2, 1))[0], same=geom.collinear_overlap(lits(0, 0), lits(2, 2), lits(1, 1), lits(3, 3)), sx=start[0], gap=geom.segment_distance2(lits(0, 0), lits(4, 0), lits(1, 2), lits(3, 1)), mid=geom.bisector_on_edge(lits(0, 0), F.lit(8), F.lit(0), lits(0, 0), lits(8, 0)), at=geom.x_at(lits(0, 0), lits(4, 8), F.lit(2)))
    assert (got.open, got.half, got.closed, got.code, got.hit, got.miss) == (False, False, True, 9, True, False)
    assert (got.x, got.y, got.none, got.same, got.sx, got.gap, got.mid, got.at) == (2.0, 2.0, None, True, 0.0, 1.0, 4.0, 1.0)


def test_triangle_distance_and_rays(spark):
    a, b, c = lits(0, 0, 0), lits(4, 0, 0), lits(0, 4, 0)
    got = one(spark, above=geom.point_triangle_distance2(lits(1, 1, 3), a, b, c), beside=geom.point_triangle_distance2(lits(-3, 0, 0), a, b, c), flat=geom.point_triangle_distance2(lits(1, 1, 0), a, b, a), t=geom.ray_hit(lits(1, 1, 5), lits(0, 0, -1), a, b, c), away=geom.ray_hit(lits(9, 9, 5), lits(0, 0, -1), a, b, c), box=geom.triangle_box_overlap((a, b, c), lits(1, 1, 0), lits(2, 2, 1)), off=geom.triangle_box_overlap((a, b, c), lits(3, 3, 0), lits(4, 4, 1)))
    assert (got.above, got.beside, got.flat, got.t, got.away, got.box, got.off) == (9.0, 9.0, 1.0, 5.0, None, True, False)


def radix_tree_nodes(codes, bits, dim):
    """Nodes by recursion over digits, without the closed form."""
    out = []

    def walk(level, prefix, own):
        if len(own) < 2 or level == bits:
            return
        out.append((level, prefix, len(own)))
        for digit in range(1 << dim):
            child = (prefix << dim) | digit
            walk(level + 1, child, [z for z in own if z >> (dim * (bits - level - 1)) == child])

    walk(0, 0, codes)
    return sorted(out)


@pytest.mark.parametrize(("codes", "width"), [([1, 2, 4, 5, 19, 24, 25, 30], 8), ([0, 2, 7, 15, 15], 4), (None, 8), (None, 128), ([3, 3], 8), ([], 8)])
def test_radix_nodes(spark, codes, width):
    r = Resolution(width)
    codes = [random.Random(width).randrange(r.volume) for _ in range(2000)] if codes is None else codes
    rows = spark.createDataFrame([(z,) for z in codes], "z long")
    got = sorted(map(tuple, octree.radix_nodes(rows, r).collect()))
    assert got == radix_tree_nodes(sorted(set(codes)), r.bits, 2)


def random_segments(spark, n, width, seed, labels=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(width), rng.randrange(width)
        rows.append((i % labels, x, y, min(max(x + rng.randrange(-20, 21), 0), width - 1), min(max(y + rng.randrange(-20, 21), 0), width - 1)))
    return rows, spark.createDataFrame(rows, "label long, ax long, ay long, bx long, by long")


def test_adaptive_tree_properties(spark):
    o = OctreeOptions(max_level=4, width=128)
    _, segs = random_segments(spark, 24, 128, 1)
    leaves, bridge = octree.adaptive_leaves(segs, o)
    cells = leaves.collect()
    assert sum(4 ** (o.max_level - c.level) for c in cells) == 4**o.max_level
    assert all(c.n_labels <= 1 for c in cells if c.level < o.max_level)
    for grow in (octree.buffered_leaves, octree.balanced_leaves):
        grown, held = grow(leaves, bridge, o)
        cells = [tuple(c)[:3] for c in grown.collect()]
        assert sum(4 ** (o.max_level - c[0]) for c in cells) == 4**o.max_level
        sides = {c: (c[1] << (4 - c[0]), c[2] << (4 - c[0]), 1 << (4 - c[0])) for c in cells}
        labels = {}
        for h in held.collect():
            labels.setdefault((h.level, h.cx, h.cy), set()).add(h.label)
        for p in cells:
            for q in cells:
                (px, py, pw), (qx, qy, qw) = sides[p], sides[q]
                if p == q or px > qx + qw or qx > px + pw or py > qy + qw or qy > py + pw:
                    continue
                if grow is octree.balanced_leaves:
                    assert abs(p[0] - q[0]) <= 1
                elif p in labels and q in labels and len(labels[p] | labels[q]) > 1:
                    assert p[0] == q[0] == o.max_level


def test_tree_looked_up_at_once_equals_descent(spark, monkeypatch):
    """Long, upright and level segments, ends on cell sides and outside the lattice, and a cell that a nameless segment has alone."""
    rng = random.Random(8)
    rows = [(i % 5, *[rng.choice((rng.randrange(128), 8 * rng.randrange(17), rng.randrange(-40, 170))) for _ in range(4)]) for i in range(30)]
    rows += [(1, 16, 8, 16, 120), (2, 24, 32, 90, 32), (3, 40, 40, 40, 40), (None, 1, 1, 2, 2)]
    lone = [(None, 100, 100, 101, 101), (1, 0, 0, 30, 30), (2, 0, 30, 30, 0)]
    for some, labels, full in ((rows, 2, True), (rows, 1024, False), (lone, 1024, False)):
        segs = spark.createDataFrame(some, "label long, ax long, ay long, bx long, by long")
        monkeypatch.setattr(octree, "LABELS", labels)
        o = OctreeOptions(max_level=3, width=128, full=full)
        got, want = octree._adaptive_flat(segs, o), octree._adaptive(segs, o)
        assert sum(4 ** (3 - c.level) for c in got[0].collect()) == 4**3
        for mine, theirs in zip(got, want, strict=True):
            assert mine.columns == theirs.columns
            assert sorted(map(repr, mine.collect())) == sorted(map(repr, theirs.collect()))


def test_tree_in_space(spark):
    o = OctreeOptions(max_level=3, width=64, dim=3)
    rng = random.Random(3)
    rows = [(i % 3, *[rng.randrange(64) for _ in range(9)]) for i in range(12)]
    tris = spark.createDataFrame(rows, "label long, ax long, ay long, az long, bx long, by long, bz long, tx long, ty long, tz long")
    leaves, _ = octree.adaptive_leaves(tris, o)
    assert sum(8 ** (3 - c.level) for c in leaves.collect()) == 8**3
    assert octree.leaf_vertices(leaves, o).count() > 8


def test_tree_in_space_looked_up_at_once_equals_fronts(spark, monkeypatch):
    """Triangles of each size, flat ones and points, on cell sides and outside the lattice; no (cell, primitive) rows are written, and many tasks share them."""
    rng = random.Random(6)
    rows = [(i % 4, *[rng.choice((rng.randrange(64), 8 * rng.randrange(9), rng.randrange(-30, 90))) for _ in range(9)]) for i in range(30)]
    rows += [(1, *[16, 8, 40] * 3), (2, 0, 0, 0, 20, 0, 0, 40, 0, 0), (None, 1, 1, 1, 2, 2, 2, 1, 2, 2), (3, None, *[5] * 8)]
    lone = [(None, *[50, 50, 50] * 3), (1, *[1, 1, 1, 20, 1, 1, 1, 20, 1])]
    for some, labels, full in ((rows, 2, True), (rows, 1024, False), (lone, 1024, False)):
        tris = spark.createDataFrame(some, "label long, " + ", ".join(f"{c} long" for c in solids.CORNERS))
        monkeypatch.setattr(octree, "LABELS", labels)
        o = OctreeOptions(max_level=3, width=64, dim=3, full=full)
        want = octree._adaptive_by_fronts(tris, o)
        written = []
        monkeypatch.setattr(octree, "TOGETHER", 32)
        monkeypatch.setattr(octree, "write_and_reread", lambda df, name: written.append(name) or write_and_reread(df, name))
        leaves = octree.adaptive_cells(tris, o)
        assert "octree-front" not in written and "octree-bridge" not in written
        got = octree.adaptive_leaves(tris, o)
        monkeypatch.undo()
        assert sorted(map(repr, leaves.collect())) == sorted(map(repr, want[0].collect()))
        for mine, theirs in zip(got, want, strict=True):
            assert mine.columns == theirs.columns
            assert sorted(map(repr, mine.collect())) == sorted(map(repr, theirs.collect()))


def test_nearest_equals_brute_force(spark):
    rows, segs = random_segments(spark, 60, 512, 2)
    queries = spark.createDataFrame([(x, y) for x in range(0, 512, 37) for y in range(0, 512, 41)], "x long, y long")
    p, a, b = vec.point("", 2), vec.point("a", 2), vec.point("b", 2)
    d2 = geom.point_segment_distance2(p, a, b)
    got = {(r.x, r.y): (r.label, r.d2) for r in spatial.nearest(queries, segs, d2, ["x", "y"], p, (vec.least(a, b), vec.greatest(a, b)), "label", [], 8).collect()}
    want = queries.crossJoin(segs).groupBy("x", "y").agg(F.min(F.struct(d2.alias("d2"), "label")).alias("b")).collect()
    assert got == {(r.x, r.y): (r.b.label, r.b.d2) for r in want}


def test_nearest_triangle_equals_brute_force(spark, sf):
    got = {(r.x, r.y, r.z): r.d2 for r in plans.nearest_triangle_3d(spark, sf).collect()}
    tris = views.triangles(spark, sf)
    d2 = geom.point_triangle_distance2(vec.point("", 3), *(vec.point(c, 3) for c in "abt"))
    pts = views.points3(spark, sf).select("x", "y", "z").distinct().limit(60)
    want = pts.crossJoin(tris).groupBy("x", "y", "z").agg(F.round(F.min(d2), 4).alias("d2")).collect()
    assert all(got[r.x, r.y, r.z] == pytest.approx(r.d2) for r in want)


def test_relaxation_is_bounded_by_the_exact_distance(spark):
    o = OctreeOptions(max_level=4, width=128)
    _, segs = random_segments(spark, 20, 128, 5)
    leaves, bridge = octree.adaptive_leaves(segs, o)
    vertices = octree.leaf_vertices(leaves, o)
    edges = octree.leaf_edges(vertices, leaves, o)
    found = wave.relax(wave.seeds(bridge, o), vertices, edges)
    assert found.count() == vertices.count()
    exact = found.crossJoin(segs.drop("label")).groupBy("x", "y", "d2").agg(F.min(geom.point_segment_distance2(vec.point("", 2), vec.point("a", 2), vec.point("b", 2))).alias("least"))
    # closest points are rounded to the lattice, by less than one unit
    assert exact.filter("sqrt(d2) < sqrt(least) - 1").count() == 0
    near = found.select("x", "y", "label", "px", "py")
    points = gvd.edge_points(edges, near)
    assert points.filter("la = lb or qx < x or qy < y or qx > x + len or qy > y + len").count() == 0
    cells = wave.ambiguous_cells(leaves, octree.incident_cells(vertices, leaves, o), near, edges, o)
    assert cells.filter("n_parts <= n_labels and n_pairs >= n_labels * (n_labels - 1) / 2").count() == 0


@pytest.mark.parametrize("dim", [2, 3])
def test_seeds_as_arrays_equal_the_columns(spark, dim, monkeypatch):
    """Flat and far primitives, equal ones of other labels, nameless ones; few of them move."""
    monkeypatch.setattr(wave, "ROWS", 40)
    rng = random.Random(5 + dim)
    corners = 2 if dim == 2 else 3
    rows = [(i % 4 or None, *[rng.choice((rng.randrange(64), 8 * rng.randrange(9), rng.randrange(-200, 300))) for _ in range(corners * dim)]) for i in range(60)]
    rows += [(7, *r[1:]) for r in rows[:20]] + [(2, *[9] * corners * dim), (3, *[40] * dim, *[16] * (corners - 1) * dim)]
    rows += [(1, *[30_000 * k for k in range(corners * dim)])]
    ends = planes.ENDS if dim == 2 else solids.CORNERS
    prims = spark.createDataFrame(rows, "label long, " + ", ".join(f"{c} long" for c in ends))
    o = OctreeOptions(max_level=2, width=64, dim=dim)
    bridge = octree.adaptive_leaves(prims, o)[1]
    found = wave._seeds(bridge, o)
    assert wave._seeds_at_once(bridge.coalesce(1), o).count() < found.count() / 3
    axes = "xyz"[:dim]
    want = found.groupBy(*axes).agg(F.min(F.struct("d2", "label", *[f"p{a}" for a in axes])).alias("s")).select(*axes, *[f"s.p{a}" for a in axes], "s.label", "s.d2")
    assert sorted(map(repr, wave.seeds(bridge, o).collect())) == sorted(map(repr, want.collect()))


def test_a_split_writes_the_flagged_leaves_rows_alone(spark, monkeypatch):
    o = OctreeOptions(max_level=3, width=128)
    _, segs = random_segments(spark, 40, 128, 4)
    leaves, bridge = octree.adaptive_leaves(segs, OctreeOptions(max_level=2, width=128))
    flagged = leaves.orderBy("level", "cx", "cy").limit(1).select("level", "cx", "cy")
    flagged = spark.createDataFrame(flagged.collect(), flagged.schema)
    written = []
    monkeypatch.setattr(octree, "write_and_reread", lambda df, name: written.append((name, df.count())) or write_and_reread(df, name))
    now, held = octree.split_leaves(leaves, bridge, flagged, o)
    one = bridge.join(flagged, ["level", "cx", "cy"], "left_semi").count()
    assert {n for n, _ in written} == {"octree-moved", "octree-leaves"} and dict(written)["octree-moved"] <= 4 * one
    assert now.count() == leaves.count() + 3
    labels = {(r.level, r.cx, r.cy): r.n for r in held.groupBy("level", "cx", "cy").agg(F.count_distinct("label").alias("n")).collect()}
    assert all(labels.get((r.level, r.cx, r.cy), 0) == r.n_labels for r in now.collect() if r.level >= 2)


def box_triangles(label, low, high):
    """The twelve triangles of a box."""
    at = lambda i: [high[j] if i >> j & 1 else low[j] for j in range(3)]
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    return [(label, *at(a), *at(b), *at(c)) for q in quads for a, b, c in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]


def test_surfaces_part_the_labels_in_space(spark):
    """Two boxes: the surface between them is closed but for the domain's sides, and lies half way."""
    o = OctreeOptions(max_level=3, width=64, dim=3)
    rows = [(i, *r) for i, r in enumerate(box_triangles(0, (6, 6, 6), (14, 58, 58)) + box_triangles(1, (46, 6, 6), (58, 58, 58)))]
    tris = spark.createDataFrame(rows, "prim_id long, label long, ax long, ay long, az long, bx long, by long, bz long, tx long, ty long, tz long")
    leaves, bridge = octree.adaptive_leaves(tris, o)
    full, held = octree.adaptive_leaves(tris, OctreeOptions(max_level=3, width=64, dim=3, full=True))
    for cells, prims in ((leaves, bridge), (full, held)):
        vertices, edges, labels = wave.relaxed_labels(cells, prims, o)
        found = {(r.x, r.y, r.z): r for r in labels.collect()}
        assert len(found) == vertices.count()
        if cells is full:
            points = gvd.edge_points(edges, labels, 3)
            assert {r.la for r in points.collect()} | {r.lb for r in points.collect()} == {0, 1} and all(24 <= r.qx <= 36 for r in points.collect())
            lines = gvd.face_fragments(points, cells, o)
            made = gvd.cell_triangles(lines).collect()
            sides = {}
            for r in made:
                if r.label == 0:
                    corners = [tuple(round(v, 6) for v in p) for p in ((r.ax, r.ay, r.az), (r.bx, r.by, r.bz), (r.tx, r.ty, r.tz))]
                    for p, q in zip(corners, corners[1:] + corners[:1]):
                        sides[p, q] = sides.get((p, q), 0) + 1
            loose = [s for s in sides if sides.get((s[1], s[0]), 0) != sides[s]]
            outer = lambda p: any(c <= 8 or c >= 56 for c in p[1:])
            assert made and all(outer(p) or outer(q) for p, q in loose)  # closed, and wound alike, inside
            up = [r for r in made if r.label == 0]
            assert all((r.by - r.ay) * (r.tz - r.az) - (r.bz - r.az) * (r.ty - r.ay) >= -1e-6 for r in up)  # away from label 0, toward larger x


def test_ambiguous_cells_are_split(spark):
    o = OctreeOptions(max_level=4, width=128)
    _, segs = random_segments(spark, 14, 128, 8, labels=7)
    leaves, bridge = octree.adaptive_leaves(segs, OctreeOptions(max_level=3, width=128))
    whole, local = [], []
    every = wave.subdivide_ambiguous(leaves, bridge, o, whole, local=False)
    leaves, bridge, (vertices, edges, labels) = wave.subdivide_ambiguous(leaves, bridge, o, local)
    # a front from the new edges ends as one over the whole lattice, and touches less of it
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, every[2][2].collect())) and len(vertices.collect()) == labels.count()
    assert sorted(map(tuple, leaves.collect())) == sorted(map(tuple, every[0].collect())) and 0 < sum(local) < sum(whole)
    left = wave.ambiguous_cells(leaves, octree.incident_cells(vertices, leaves, o), labels, edges, o)
    assert left.filter("level < 4").count() == 0
    assert sum(4 ** (4 - c.level) for c in leaves.collect()) == 4**4


def test_sheets_have_no_broken_edges(spark):
    fan = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 9), (2, 0, 1, 3), (3, 0, 1, 4), (4, 4, 1, 8)], "prim_id long, a long, b long, c long")
    made, copies = mesh.split_sheets(fan, 4)
    assert mesh.nonmanifold_edges(made).count() == 0
    rows = {r.prim_id: r for r in made.collect()}
    assert rows[0].sheet == rows[1].sheet == 0 and rows[2].sheet == 2 and rows[3].sheet == rows[4].sheet == 3
    back = {(r.sheet, r.to): r.vid for r in copies.collect()}
    assert len(back) == 4 and {back.get((rows[2].sheet, v), v) for v in (rows[2].a, rows[2].b, rows[2].c)} == {0, 1, 3}
    new, mapping = mesh.compact(made, 2)
    assert sorted(r.to for r in mapping.collect()) == list(range(mapping.count())) and new.filter("prim_id = 0 and a = 0 and b = 1 and c = 2").count() == 1


def test_v_segments_and_networks(spark):
    tip, end, near, far = geom.v_segments(lits(0.0, 1.2), lits(1.0, 10.0), lits(0.0, 0.0), lits(10.0, 10.0))
    got = one(spark, tip=F.array(*tip), end=F.array(*end), near=F.array(*near), far=F.array(*far))
    assert got.tip == [0.0, 1.2] and got.end == [1.0, 10.0] and got.near == pytest.approx([0.6, 0.6]) and got.far == [10.0, 10.0]
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "x long, y long")
    assert graph.network_differences(a, a).count() == 0 and graph.network_differences(a, a.distinct()).count() == 1


def test_components_paths_and_rings(spark, sf):
    edges = views.trade_graph(spark, sf)
    rows = edges.collect()
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        p, q = root(r.u), root(r.v)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {n: root(n) for n in parent}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    for few in (0, graph.FEW):
        assert {r.component for r in graph.connected_components(chain, few=few).collect()} == {0}
        assert {r.node: r.component for r in graph.connected_components(edges, few=few).collect()} == got
        assert graph.connected_components(chain.limit(0), few=few).count() == 0
        named = chain.select(F.concat(F.lit("n"), "u").alias("u"), F.concat(F.lit("n"), "v").alias("v"))
        assert {r.component for r in graph.connected_components(named, few=few).collect()} == {"n0"}
    assert graph.connected_components(chain.limit(0)).count() == 0
    paths = graph.shortest_paths(spark.createDataFrame([(0, 1, 5), (0, 2, 1), (2, 1, 1), (3, 4, 1)], "u long, v long, w long"), 0)
    assert {r.node: (r.cost, r.parent) for r in paths.collect()} == {0: (0, None), 2: (1, 0), 1: (2, 2)}
    assert graph.path_to(paths, 1) == [1, 2, 0] and graph.path_to(paths, 4) == []
    rings = graph.k_rings(chain, spark.createDataFrame([(5,)], "node long"), 3)
    assert sorted((r.ring, r.node) for r in rings.collect()) == [(0, 5), (1, 4), (1, 6), (2, 3), (2, 7), (3, 2), (3, 8)]


def test_mesh(spark):
    tris = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3), (2, 2, 3, 4), (9, 7, 8, 9)], "prim_id long, a long, b long, c long")
    flips = {r.prim_id: r.flip for r in mesh.orient(tris).collect()}
    assert flips == {0: False, 1: True, 2: False, 9: False}
    assert mesh.dual_graph(tris).count() == 2 and mesh.nonmanifold_edges(tris).count() == 0
    fan = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3), (2, 0, 1, 4)], "prim_id long, a long, b long, c long")
    assert [tuple(r) for r in mesh.nonmanifold_edges(fan).collect()] == [(0, 1, 3)]
    ring = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 1, 0.8, 0.6, 0.0), (0, 2, -1.0, 0.0, 0.0)], "ring long, ord int, nx double, ny double, nz double")
    assert sorted((r.region, r.n) for r in mesh.region_merge(ring, "ring").collect()) == [(0, 2), (1, 1)]


def test_quantise_and_scans(spark):
    pts = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "fx double, fy double")
    assert {(r.x, r.y) for r in quantise.quantise(pts, {"fx": "x", "fy": "y"}, 16).collect()} == {(0, 0)}
    rows = spark.createDataFrame([(i, i % 7) for i in range(200)], "i long, v long")
    got = [r.s for r in stats.prefix_sum(rows, "v", F.floor(F.col("i") / 13), ["i"], "s").orderBy("i").collect()]
    assert got == [sum(j % 7 for j in range(i)) for i in range(200)]
    nxt = {r.i: r.n for r in stats.next_in_order(rows.select("i"), "i", F.floor(F.col("i") / 13), "n").collect()}
    assert nxt == {i: i + 1 if i < 199 else None for i in range(200)}


def test_nearest_by_bounds_is_exact_with_many_features_and_copies(spark, monkeypatch):
    """Several passes, copies of one feature, ties, and features far from the queries; nothing is aggregated as sorted pairs of all."""
    rng = random.Random(8)
    rows = [(k % 5, *(rng.randrange(256) for _ in range(4))) for k in range(400)] + [(7, 3, 3, 9, 3)] * 300
    segs = spark.createDataFrame(rows, "label long, ax long, ay long, bx long, by long")
    queries = spark.createDataFrame([(x, y) for x in range(0, 257, 32) for y in range(0, 257, 32)] + [(1000, 1000)], "x long, y long")
    for name, value in (("FIRST", 8), ("PAIRS", 600), ("MORE", 2), ("TOGETHER", 50)):
        monkeypatch.setattr(spatial, name, value)
    p, a, b = vec.point("", 2), vec.point("a", 2), vec.point("b", 2)
    d2 = geom.point_segment_distance2(p, a, b)
    found = spatial.nearest(queries, segs, d2, ["x", "y"], p, (vec.least(a, b), vec.greatest(a, b)), "label", [], 16)
    best = queries.crossJoin(segs).groupBy("x", "y").agg(F.min(F.struct(d2.alias("d2"), "label")).alias("b")).select("x", "y", "b.label", "b.d2")
    assert sorted(found.collect()) == sorted(best.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(k for k, line in enumerate(plan) if "Join Inner" in line)
    folds = [line for line in plan[:join] if "Aggregate" in line]
    assert "struct" not in folds[-1] and "struct" in folds[0]  # all pairs are folded as numbers; structs, which are sorted, only for the few left


def random_triangles(spark, n, width, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = [rng.randrange(width) for _ in range(3)]
        rows.append((i, i % 5, *at, *[c + rng.randrange(-9, 10) for _ in range(2) for c in at]))
    rows += [(n, 1, *[7] * 9), (n + 1, 2, 0, 0, 0, 4, 4, 4, 8, 8, 8), (n + 2, 3, *rows[0][2:]), (n + 3, 3, None, *rows[0][3:])]
    return spark.createDataFrame(rows, "prim_id long, label long, " + ", ".join(f"{c} long" for c in solids.CORNERS))


def test_triangles_as_arrays_equal_the_columns(spark):
    tris = random_triangles(spark, 60, 64, 7)
    corners = tuple(vec.point(c, 3) for c in "abt")
    cells = spark.createDataFrame([(3, x, y, z) for x in range(8) for y in range(8) for z in range(8)], "level int, cx long, cy long, cz long")
    low = tuple(F.col(f"c{a}") * 8 for a in "xyz")
    key = ["prim_id", "cx", "cy", "cz"]
    want = sorted(map(tuple, tris.crossJoin(cells).filter(geom.triangle_box_overlap(corners, low, tuple(c + 8 for c in low))).select(*key).collect()))
    assert sorted(map(tuple, solids.in_cells(cells.crossJoin(tris), 64).select(*key).collect())) == want
    assert sorted(map(tuple, spatial.triangle_cells(tris, 8, 8).select(*key).collect())) == want


@pytest.mark.parametrize("span", [1 << 20, 10])
def test_nearest_triangles_by_blocks_equal_brute_force(spark, monkeypatch, span):
    for name, value in (("FIRST", 4), ("BLOCK", 16), ("POINTS", 8)):
        monkeypatch.setattr(solid, name, value)
    monkeypatch.setattr(solids, "SPAN", min(span, solids.SPAN))
    tris = random_triangles(spark, 90, 64, 8)
    rng = random.Random(9)
    points = [tuple(rng.randrange(-20, 90) for _ in range(3)) for _ in range(60)] + [(7, 7, 7), (4, 4, 4), (4, 4, 4), (None, 1, 1), (900, -900, 5)]
    points = spark.createDataFrame(points + [tuple(r) for r in tris.select("ax", "ay", "az").limit(20).collect()], "x long, y long, z long")
    found = solid.nearest_triangle(points, tris, "label", [-F.col("prim_id")], {"prim_id": F.col("prim_id")})
    d2 = geom.point_triangle_distance2(vec.point("", 3), *(vec.point(c, 3) for c in "abt"))
    every = points.dropna().distinct().crossJoin(tris.dropna()).withColumn("d2", d2)
    want = every.groupBy("x", "y", "z").agg(F.min(F.struct("d2", -F.col("prim_id"), "label", "prim_id")).alias("b")).select("x", "y", "z", "b.label", "b.d2", "b.prim_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert solid.nearest_triangle(points, tris.limit(0), "label", [], {}).columns == ["x", "y", "z", "label", "d2"]


def test_rings_of_packed_paths_equal_brute_force(spark, monkeypatch):
    """Few pairs at a time, far apart and negative numbers, a hub, a null source; strings keep the plain joins."""
    monkeypatch.setattr(graph, "ROWS", 4)
    rng = random.Random(4)
    names = [-(1 << 62), -5, 1 << 62, 300, *range(60), 70_000, 1 << 33]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)] + [(7, n) for n in names[::3]]
    near = {n: set() for n in names}
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    want = set()
    for c in names:
        ring, seen = {c}, {c}
        for k in range(4):
            want |= {(c, n, k) for n in ring}
            ring = {v for n in ring for v in near[n]} - seen
            seen |= ring
    for kind in ("long", "string"):
        told = (lambda n: n) if kind == "long" else str
        rows = spark.createDataFrame([(told(u), told(v)) for u, v in edges], f"u {kind}, v {kind}")
        sources = spark.createDataFrame([(told(n),) for n in names] + ([(None,)] if kind == "long" else []), f"node {kind}")
        got = [tuple(r) for r in graph.k_rings(rows, sources, 3).collect() if r.center is not None]
        assert len(got) == len(want) and set(got) == {(told(c), told(n), k) for c, n, k in want}


def test_rings_are_the_same_in_turns(spark, monkeypatch):
    rng = random.Random(8)
    edges = spark.createDataFrame([(2 * rng.randrange(30), 2 * rng.randrange(40) + 1) for _ in range(160)], "u long, v long")
    sources = edges.select(F.col("u").alias("node"))
    whole = sorted(map(tuple, graph.k_rings(edges, sources, 3).collect()))
    written, real = [], graph.write_and_reread
    monkeypatch.setattr(graph, "PATHS", 1)
    monkeypatch.setattr(graph, "write_and_reread", lambda df, name, *a: written.append((name, df.columns)) or real(df, name, *a))
    assert sorted(map(tuple, graph.k_rings(edges, sources, 3).collect())) == whole
    assert sum(name == "rings" for name, _ in written) > 3  # a ring's centres came in turns
    written.clear()
    sizes = sorted(map(tuple, graph.ring_sizes(edges, sources, 3).collect()))
    assert sizes == sorted((c, k, n) for (c, k), n in Counter((c, k) for c, _, k in whole).items())
    assert [columns for name, columns in written if name == "rings"][-1] == ["center", "n"]  # the last ring's nodes are not written


def test_packed_pairs_survive_small_chunks(monkeypatch):
    monkeypatch.setattr(pairs, "TOGETHER", 8)
    rng = random.Random(6)
    made = sorted((rng.choice((1, 2, -(1 << 63))), rng.choice((rng.randrange(9), rng.randrange(1 << 40), (1 << 63) - 1, -(1 << 63)))) for _ in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in made], pa.int64()) for i in (0, 1)], ["one", "two"])
    packed = sorted((b for part in pairs.pack(False)(iter([batch])) for b in [part.slice(i, 1) for i in range(part.num_rows)]), key=lambda b: b.column(0)[0].as_py())
    known = list(pairs.pack(True)(iter([batch.slice(0, 5)])))
    got = [tuple(r.values()) for part in pairs.fresh(["one", "two"])(iter(sorted([*packed, *[k.slice(i, 1) for k in known for i in range(k.num_rows)]], key=lambda b: b.column(0)[0].as_py()))) for r in part.to_pylist()]
    assert got == sorted(set(made) - set(made[:5]))


def test_links_of_paths_are_dealt_by_their_number(spark, monkeypatch):
    """More tasks than shuffle partitions; repeated edges either way count once, with the least weight."""
    monkeypatch.setattr(graph, "LIGHT", 2)
    edges = spark.createDataFrame([(1, 2, 5), (2, 1, 3), (2, 3, 4), (3, 2, 9), (3, 3, 0), (1, 3, 9), (4, 5, 1), (None, 1, 1)], "u long, v long, w long")
    assert sorted(map(tuple, graph.shortest_paths(edges, 1).collect())) == [(1, 0, None), (2, 3, 1), (3, 7, 2)]
