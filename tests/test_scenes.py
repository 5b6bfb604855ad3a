"""Planar graphs, fitted boxes, refined trees, exploded views and branches on small inputs, against plain versions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.morton import Resolution
from lattica.operators import bases, branches, crossing, explode, fitting, gvd, octree, refine
from lattica.operators.octree import OctreeOptions
from lattica.plans import scene_queries, space_queries
from lattica.sources import tree_files

SEGMENTS = "scene int, label int, ord int, ax long, ay long, bx long, by long, other string"


def segments(spark, rows):
    return spark.createDataFrame([(s, i % 3, i, *map(int, e), "x") for i, (s, *e) in enumerate(rows)], SEGMENTS).repartition(3)


def side(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def plain_cuts(rows, i):
    """Places on segment i at which it is cut, as fractions."""
    s, ax, ay, bx, by = rows[i]
    a, b, found = (ax, ay), (bx, by), {(Fraction(ax), Fraction(ay)), (Fraction(bx), Fraction(by))}
    for j, (t, cx, cy, dx, dy) in enumerate(rows):
        c, d = (cx, cy), (dx, dy)
        if j == i or t != s:
            continue
        one, two = side(a, b, c) * side(a, b, d), side(c, d, a) * side(c, d, b)
        if one < 0 and two < 0:
            k = Fraction(side(c, d, a), side(c, d, a) - side(c, d, b))
            found.add((ax + k * (bx - ax), ay + k * (by - ay)))
        for e in (c, d):
            if side(a, b, e) == 0 and min(ax, bx) <= e[0] <= max(ax, bx) and min(ay, by) <= e[1] <= max(ay, by):
                found.add((Fraction(e[0]), Fraction(e[1])))
    return sorted(found)


def place(p):
    return tuple(v for c in p for v in (math.floor(c), math.floor((c - math.floor(c)) * crossing.PARTS)))


@pytest.mark.parametrize("sides", [(4, 4), (64, 2), None])
def test_planar_graph_equals_plain_cuts(spark, sides, monkeypatch):
    monkeypatch.setattr(crossing, "BLOCK", 5)
    rnd = random.Random(3)
    rows = list(dict.fromkeys([(rnd.randrange(2), *(rnd.randrange(24) for _ in range(4))) for _ in range(60)] + [(0, 0, 5, 20, 5), (0, 3, 5, 9, 5), (0, 9, 5, 30, 5), (0, 7, 0, 7, 20), (0, 7, 3, 7, 9), (0, 4, 4, 4, 4)]))
    rows = [r for r in rows if r[1:3] != r[3:5]]
    want = {(r[0], place(u), place(v)) for i, r in enumerate(rows) for u, v in zip(plain_cuts(rows, i), plain_cuts(rows, i)[1:], strict=False)}
    made = crossing.planar_graph(segments(spark, rows), ["label", "ord"], "scene", 64, sides)
    got = [(r.scene, (r.ux, r.uxp, r.uy, r.uyp), (r.vx, r.vxp, r.vy, r.vyp)) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_meeting_pairs_once_and_crossings_by_label(spark, monkeypatch):
    monkeypatch.setattr(crossing, "BLOCK", 4)
    rnd = random.Random(8)
    rows = [(0, *(rnd.randrange(40) for _ in range(4))) for _ in range(70)]
    ends = lambda i: (rows[i][1:3], rows[i][3:5])
    want = set()
    for i in range(70):
        for j in range(70):
            (a, b), (c, d) = ends(i), ends(j)
            if i % 3 < j % 3 and side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                want.add((i, j))
    got = [(r.p_ord, r.q_ord) for r in crossing.crossings(segments(spark, rows), ["ord"], (8, 16)).collect()]
    assert sorted(got) == sorted(want)


def test_odd_segments(spark):
    none = segments(spark, [(0, 0, 0, 1, 1)]).limit(0)
    assert crossing.planar_graph(none, ["ord"], "scene", 64).count() == 0 and crossing.crossings(none, ["ord"]).count() == 0
    same = segments(spark, [(0, 0, 0, 8, 8), (1, 0, 8, 8, 0)]).drop("ord").withColumnRenamed("label", "k")
    twice = same.unionAll(same)
    assert crossing.planar_graph(twice, ["k"], "scene", 64).count() == 2
    lost = spark.createDataFrame([(0, 0, 1, None, 0, 8, 8, "x"), (0, 1, 2, 0, 8, 8, 0, "x")], SEGMENTS)
    assert crossing.crossings(lost, ["ord"]).count() == 0
    with pytest.raises(ValueError):
        crossing.planar_graph(same, ["k"], "scene", 1 << 15)


def plain_march(a, b, c, d, least):
    far = math.dist
    length, at, out = max(far(a, b), far(c, d)), 0.0, []
    while at <= length:
        t = at / length if length else 0.0
        p = [u + t * (v - u) for u, v in zip(a, b, strict=True)]
        v = [y - x for x, y in zip(c, d, strict=True)]
        n = v[0] ** 2 + v[1] ** 2
        s = min(1.0, max(0.0, ((p[0] - c[0]) * v[0] + (p[1] - c[1]) * v[1]) / n)) if n else 0.0
        q = [x + s * y for x, y in zip(c, v, strict=True)]
        size = max(far(p, q), least)
        out.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, size))
        at += size
    return out


def fitted(spark, pairs, least):
    rows = spark.createDataFrame([(i, *[None if x is None else float(x) for x in p]) for i, p in enumerate(pairs)], "k int, " + ", ".join(f"{c} double" for c in fitting.ENDS))
    out = {}
    for r in fitting.fit_boxes(rows, least).orderBy("k", "part", "step").collect():
        out.setdefault((r.k, r.part), []).append(((r.x, r.y, r.size), (r.px, r.py), (r.qx, r.qy)))
    return out


def flat(boxes):
    return [x for b in boxes for x in b]


def test_boxes_of_near_segments(spark):
    got = fitted(spark, [(160, 65, 155, 65, 160, 67, 156, 67), (17136, 12798, 17133, 12800, 17136, 12799, 17135, 12800), (5, 5, 5, 5, 9, 5, 9, 5)], 1.0)
    assert flat(b for b, *_ in got[0, 0]) == pytest.approx(flat(plain_march((160, 65), (155, 65), (160, 67), (156, 67), 1.0)))
    assert len(got[0, 0]) == 3 and got[0, 0][0][1:] == ((160, 65.5), (160, 66.5))
    assert got[2, 0] == [((7, 5, 4), (6, 5), (8, 5))] and set(got) == {(0, 0), (1, 0), (2, 0)}


def test_crossing_segments_have_two_wedges(spark):
    got = fitted(spark, [(0, 0, 40, 40, 0, 40, 40, 0), (0, 0, 40, 0, 39, -20, 39, 30), (19, 0, 21, 0, 20, -30, 20, 30)], 4.0)
    assert got[0, 0] == [((20, 20, 4), (20, 20), (20, 20))]
    assert flat(b for b, *_ in got[0, 1]) == pytest.approx(flat(plain_march((18, 18), (0, 0), (18, 22), (0, 40), 4.0)))
    assert flat(b for b, *_ in got[0, 2]) == pytest.approx(flat(plain_march((22, 22), (40, 40), (22, 18), (40, 0), 4.0)))
    assert {k for k in got if k[0] == 1} == {(1, 0), (1, 1)} and {k for k in got if k[0] == 2} == {(2, 0)}  # arms that end in the box


def test_marches_are_whole(spark, monkeypatch):
    monkeypatch.setattr(fitting, "TOGETHER", 2)
    got = fitted(spark, [(0, 0, 30_000, 0, 0, 1, 30_000, 1), (0, 0, 10, 0, 0, 3, 10, 3), (0, 0, 1, None, 0, 0, 1, 1), (0, 0, float("inf"), 0, 0, 0, 1, 1), (9, 9, 1, 1, 1, 9, 9, 30)], 1.0)
    assert len(got[0, 0]) == 30_001 and got[0, 0][-1][0][0] == 30_000 and {k for k, _ in got} == {0, 1, 4}
    with pytest.raises(ValueError):
        fitted(spark, [], 0)
    assert fitted(spark, [], 1.0) == {}


def test_refined_tree_has_conflicts_in_unit_cells_alone(spark):
    r = Resolution(32)
    rnd = random.Random(6)
    rows = [(0, *(rnd.randrange(32) for _ in range(4))) for _ in range(6)] + [(0, 3, 3, 3, 3), (0, 0, 0, 31, 1)]
    segs = segments(spark, rows)
    given = {(x, y) for _, ax, ay, bx, by in rows for x, y in ((ax, ay), (bx, by))}
    points = spark.createDataFrame([*given, (None, 4)], "x int, y int")
    state, cells = refine.refine(points, segs, r)
    state, cells = [tuple(p) for p in state.collect()], [tuple(c) for c in cells.collect()]
    every = {(x, y) for x, y, _ in state}
    assert len(every) == len(state) and {(x, y) for x, y, level in state if level is None} == given
    assert all(n == 1 for level, _, _, n in cells if level < r.bits) and any(n > 1 for *_, n in cells)
    held = lambda level, cx, cy: sum((x >> r.bits - level, y >> r.bits - level) == (cx, cy) for x, y in every)
    assert all(held(level, cx, cy) < 2 for level, cx, cy, _ in cells)  # these are leaves of the tree over the points
    for x, y, level in state:  # a point was added for a cell that is split since
        assert level is None or held(level, x >> r.bits - level, y >> r.bits - level) > 1
    # without conflicts nothing is added, and empty tables are no harm
    assert refine.refine(points, segs.withColumn("label", F.lit(1)), r)[0].count() == len(given)
    none, no_cells = refine.refine(points.limit(0), segs.limit(0), r)
    assert none.count() == 0 and no_cells.count() == 0


PAIRS = "a int, b int, nx double, ny double, nz double, area double"


def test_refinement_looked_up_at_once_equals_fronts(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(0, *(rnd.randrange(32) for _ in range(4))) for _ in range(14)] + [(0, 3, 3, 3, 3), (0, 8, 0, 8, 31), (0, 0, 16, 31, 16)]
    segs = segments(spark, rows).select("label", "ax", "ay", "bx", "by")
    points = spark.createDataFrame([(1, 1), (1, 1), (30, 2), (17, 29), (40, 5), (None, 3)], "x int, y int")
    r = Resolution(32)
    want = refine._refine_by_fronts(points, segs.distinct(), r)
    written = []
    real = refine.write_and_reread
    monkeypatch.setattr(refine, "write_and_reread", lambda df, name: written.append(name) or real(df, name))
    got = refine.refine(points, segs, r)
    assert "refine-front" not in written
    for mine, theirs in zip(got, want, strict=True):
        assert sorted(map(repr, mine.select(theirs.columns).collect())) == sorted(map(repr, theirs.collect()))


def test_explode_offsets_spread_from_the_anchor(spark):
    pairs = spark.createDataFrame([(0, 1, 3.0, 4.0, 0.0, 2.0), (0, 2, 0.0, 0.0, -5.0, 1.0), (1, 3, 9.0, 9.0, 9.0, 3.0), (2, 3, 1.0, 0.0, 0.0, 4.0), (3, 4, 1.0, 1.0, 1.0, 1.0), (5, 6, 1.0, 0.0, 0.0, 1.0), (0, 7, 0.0, 0.0, 0.0, 1.0), (None, 0, 1.0, 1.0, 1.0, 1.0)], PAIRS)
    got = {r.label: (r.ring, (r.ox, r.oy, r.oz)) for r in explode.explode_offsets(pairs, 0, 10.0).collect()}
    three = (3 * 6.0, 3 * 8.0, 4 * -10.0)
    size = math.hypot(*three)
    assert set(got) == {0, 1, 2, 3, 4, 7} and got[0] == (0, (0, 0, 0)) and got[7] == (1, (0, 0, 0))
    assert got[1][1] == pytest.approx((6, 8, 0)) and got[2][1] == pytest.approx((0, 0, -10))
    assert got[3] == (2, pytest.approx(tuple(20 * c / size for c in three))) and got[4] == (3, pytest.approx(tuple(30 * c / size for c in three)))
    assert explode.explode_offsets(pairs.limit(0), 0, 10.0).count() == 1
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "p"), (6, 1.0, 2.0, 3.0, "q")], "label int, x double, y double, z double, other string")
    offsets = explode.explode_offsets(pairs, 0, 10.0, 1)
    out = {r.other: (r.x, r.y, r.z) for r in explode.moved(points, offsets, explode.explode_step(pairs.select(F.col("area").cast("long").alias("d")), "d", 9)).collect()}
    assert out == {"p": pytest.approx((0, 0, 0)), "q": (1, 2, 3)}
    far = explode.explode_step(spark.createDataFrame([(15,), (20,)], "d long"), "d", 9)
    assert explode.moved(points, offsets, far).filter("label = 1").first()[1:4] == pytest.approx((5.4, 7.2, 0))


def plain_branch(points):
    lines = []
    points = [(p, i) for i, p in enumerate(points)]
    while True:
        n = len(points)
        gap = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
        one = min(range(n), key=lambda i: gap(points[i][0], points[(i + 1) % n][0]))
        two = (one + 1) % n
        far = max(range(n), key=lambda i: (gap(points[one][0], points[i][0]), -i))
        centre = tuple(sum(x) / 3 for x in zip(points[one][0], points[two][0], points[far][0], strict=True))
        lines += [(points[k][1], points[k][0], centre) for k in ((one, two) if n > 3 else range(3))]
        if n == 3:
            return lines
        points[one] = (centre, points[one][1])
        del points[two]


@pytest.mark.parametrize("n", [3, 4, 7])
def test_branches_equal_plain_ones(n):
    rng = np.random.default_rng(n)
    rings = rng.normal(size=(20, n, 3))
    rings[0] = [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [2, 2, 2], [3, 3, 3], [4, 4, 4]][:n]
    got = {i: [] for i in range(20)}
    for rows, point, ends in branches.branch(rings):
        for i, p, e in zip(rows.tolist(), point.tolist(), ends.tolist(), strict=True):
            got[i].append((p, tuple(e[:3]), tuple(e[3:])))
    for i in range(20):
        want = plain_branch([tuple(p) for p in rings[i].tolist()])
        assert [p for p, *_ in sorted(got[i])] == [p for p, *_ in sorted(want)]
        assert flat(flat(x[1:]) for x in sorted(got[i])) == pytest.approx(flat(flat(x[1:]) for x in sorted(want)))


def test_face_rings_begin_at_the_low_corner(spark):
    rim = [(2, 0, 0, 0, 8, 1, 2, 8.0, 3.0, 0.0), (2, 0, 0, 0, 8, 3, 4, 5.0, 0.0, 0.0), (2, 8, 0, 0, 8, 1, 2, 9.0, 0.0, 0.0), (0, 0, 0, 0, 8, 5, 6, 0.0, 0.0, 1.0), (0, 0, 0, 0, 8, 7, 8, 0.0, 8.0, 1.0), (0, 0, 0, 0, 8, 9, 9, 0.0, 3.0, 0.0)]
    rims = spark.createDataFrame(rim, "normal int, fx long, fy long, fz long, w long, la int, lb int, qx double, qy double, qz double")
    got = branches.face_branches(rims).collect()
    assert [(r.la, r.lb, r.ax, r.ay, r.bx, r.by) for r in got if r.normal == 2] == [(3, 4, 5, 0, 8, 3)]
    assert sorted(r.la for r in got if r.normal == 0) == [5, 7, 9] and len({(r.bx, r.by, r.bz) for r in got if r.normal == 0}) == 1
    assert branches.face_branches(rims.limit(0)).count() == 0


def test_cell_ends(spark):
    rows = spark.createDataFrame([(0, 0, 16, 16, 0, 0), (4, 4, 20, 4, 0, 0), (2, 2, 3, 3, 0, 0), (0, 3, 0, 5, 0, 0), (5, 5, 5, 5, 0, 0), (12, 0, 0, 12, 0, 0)], "ax long, ay long, bx long, by long, cx long, cy long")
    got = {(r.ax, r.ay, r.bx, r.by): (r.n, r.x0, r.y0, r.x1, r.y1) for r in branches.cell_ends(rows, 8).collect()}
    assert got[0, 0, 16, 16] == (2, 0, 0, 8, 8) and got[4, 4, 20, 4] == (1, 8, 4, None, None) and got[2, 2, 3, 3] == got[5, 5, 5, 5] == (0, None, None, None, None)
    assert got[12, 0, 0, 12] == (2, 8, 4, 4, 8) and got[0, 3, 0, 5][0] == 0  # along a side it meets no other


def test_bases_of_a_small_tree(spark):
    o = OctreeOptions(max_level=2, width=8, dim=3)
    cells = [(1, x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1) if (x, y, z) != (0, 0, 0)] + [(2, x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    leaves = spark.createDataFrame(cells, "level int, cx long, cy long, cz long")
    vertices = octree.leaf_vertices(leaves, o)
    found = bases.bases(vertices, leaves, o)
    rows = {(r.x, r.y, r.z): r for r in bases.by_direction(found, o).select("*", bases.within_sides(0).alias("s0"), bases.on_boundary(0).alias("far0"), bases.base_with_fallbacks(2).alias("up")).collect()}
    assert len(rows) == vertices.count() and found.groupBy("x", "y", "z", "direction").count().filter("count > 1").count() == 0
    middle = rows[2, 2, 2]
    assert middle.b0.level == middle.b7.level == 2 and (middle.b7.cx, middle.b7.dist) == (0, 6) and middle.up.dist == 2 and not middle.s0
    edge = rows[8, 8, 8]  # the far corner has the last leaf behind it alone
    assert [edge[f"b{d}"] is not None for d in range(8)] == [False] * 7 + [True] and edge.up == edge.b7 and not edge.far0
    hanging = rows[4, 2, 2]  # on the side of a coarse leaf
    assert hanging.b0 is None and hanging.b1.level == 2 and hanging.far0 and hanging.b6.level == 1 and hanging.b6.dist == 4 and hanging.s0
    assert bases.by_direction(bases.bases(vertices.limit(0), leaves, o), o).count() == 0


def test_walks_end_at_gaps(spark):
    o = OctreeOptions(max_level=2, width=8, dim=2)
    leaves = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 1, 1), *[(2, x, y) for x in (0, 1) for y in (0, 1)]], "level int, cx long, cy long")
    vertices = octree.leaf_vertices(leaves, o)
    got = {(r.x, r.y, r.axis): (r.back, r.ahead) for r in bases.next_base(vertices, octree.leaf_edges(vertices, leaves, o), leaves, o).collect()}
    assert got[2, 2, 0] == (2, None) and got[4, 2, 0] == (2, None)  # no edge goes on into the coarse leaf
    assert got[0, 0, 0] == (None, 2) and got[8, 0, 0] == (4, None) and got[4, 4, 1] == (4, None) and got[0, 0, 1] == (None, 2)


def test_leaf_lines_round_trip_and_odd_lines(spark, tmp_path):
    cells = [(0, 0, 0, 0, 1), (3, 5, 0, 7, None), (1, 1, 1, 0, 2)]
    leaves = spark.createDataFrame(cells, "level int, cx long, cy long, cz long, n int")
    assert {r.value for r in tree_files.leaf_lines(leaves, 3, "n").collect()} == {"- 1", "545 -", "3 2"}
    tree_files.write_leaves(leaves, f"{tmp_path}/leaves", 3, "n")
    assert {tuple(r) for r in tree_files.read_leaves(spark, f"{tmp_path}/leaves", 3, "n").collect()} == set(cells)
    (tmp_path / "odd.txt").write_text("31 7\n\n4 1\nx 2\n- many\n" + "0" * 63 + " 5\n2")
    got = [tuple(r) for r in tree_files.read_leaves(spark, f"{tmp_path}/odd.txt", 2, "n").collect()]
    assert got == [(2, 3, 2, 7), (None, None, None, 1), (None, None, None, 2), (0, 0, 0, None), (None, None, None, 5), (1, 0, 1, None)]


def test_fields_inside_leaves(spark):
    o = OctreeOptions(max_level=1, width=8, dim=2)
    leaves = spark.createDataFrame([(1, x, y) for x in (0, 1) for y in (0, 1)], "level int, cx long, cy long")
    values = spark.createDataFrame([(x, y, float(3 * x + y)) for x in (0, 4, 8) for y in (0, 4, 8) if (x, y) != (8, 8)], "x long, y long, value double")
    pixels = spark.createDataFrame([(1, 3), (4, 4), (8, 0), (8, 3), (7, 7), (9, 1), (1, 3), (None, 1)], "x long, y long")
    got = {(r.x, r.y): r.field for r in gvd.leaf_field(pixels, leaves, values, o).collect()}
    assert got == {(1, 3): pytest.approx(6), (8, 0): pytest.approx(24), (8, 3): pytest.approx(27)}  # (4, 4) and (7, 7) lie in the leaf that lacks a corner
    assert gvd.leaf_field(pixels, leaves.limit(0), values, o).count() == 0


def test_cells_of_small_scenes_hold_many_segments(spark):
    rows = [(k % 40, k, x, y, x + k % 9, y + k % 7) for k in range(1600) for x, y in [(k * 37 % 4000, k * 53 % 4000)]]
    segs = spark.createDataFrame(rows, "scene long, k long, ax long, ay long, bx long, by long")
    assert crossing.crossing_sides(segs) == (4, 4)
    wide = crossing.crossing_sides(segs, "scene")
    assert min(wide) >= 2048  # 40 segments a scene fill no more cells
    pairs = [sorted(map(tuple, crossing.meeting_pairs(segs, ["k"], scene="scene", sides=s).select(F.least("p_k", "q_k"), F.greatest("p_k", "q_k")).collect())) for s in (wide, (64, 64))]
    assert pairs[0] == pairs[1]


def test_the_pipeline_in_space_has_leaves_to_split(spark, sf, monkeypatch):
    """Its tree is that of the other queries in space."""
    seen = []

    class Done(Exception):
        pass

    def told(leaves, bridge, o):
        seen.append((o, leaves.filter(F.col("level") < o.max_level).count()))
        raise Done

    monkeypatch.setattr(scene_queries.wave, "subdivide_ambiguous", told)
    with pytest.raises(Done):
        scene_queries.gvd_pipeline_3d(spark, sf)
    assert seen[0][0] == space_queries.TREE3 and seen[0][1] > 0
