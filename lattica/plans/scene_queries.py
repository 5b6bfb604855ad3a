"""Registered queries of planar graphs, fitted boxes, branches on faces, and exploded views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import bases, branches, crossing, explode, fitting, gvd, octree, refine, spatial, wave
from lattica.plans import oracle, views
from lattica.plans.queries import COUNT, SIDE, SMALL, gvd_points, nearest_segment, query
from lattica.plans.space_queries import TREE3, surface_parts, triangle_prims
from lattica.session import scratch_path, write_and_reread
from lattica.sources import tree_files

#: Polylines of so many labels make a scene.
SCENE = 8
LEAST = 16.0


def _scenes(spark, sf_dir) -> DataFrame:
    return views.segments(spark, sf_dir).withColumn("scene", F.floor(F.col("label") / SCENE))


_ON = "(bx - ax) * ({y} - ay) - (by_ - ay) * ({x} - ax)"
_SIGNS = "sign((p.bx - p.ax) * (q.ay - p.ay) - (p.by_ - p.ay) * (q.ax - p.ax)) * sign((p.bx - p.ax) * (q.by_ - p.ay) - (p.by_ - p.ay) * (q.bx - p.ax)) < 0 AND sign((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax)) * sign((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax)) < 0"
_UP = "((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax))"
_DOWN = f"({_UP} - ((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax)))"


def _touch(c: str) -> str:
    return f"SELECT p.scene, p.label, p.ord, q.{c}x AS x, 0 AS xp, q.{c}y{'_' * (c == 'b')} AS y, 0 AS yp FROM s p JOIN s q ON p.scene = q.scene WHERE " + _ON.replace("ax", "p.ax").replace("bx", "p.bx").replace("ay", "p.ay").replace("by_", "p.by_").format(x=f"q.{c}x", y=f"q.{c}y{'_' * (c == 'b')}") + f" = 0 AND q.{c}x BETWEEN least(p.ax, p.bx) AND greatest(p.ax, p.bx) AND q.{c}y{'_' * (c == 'b')} BETWEEN least(p.ay, p.by_) AND greatest(p.ay, p.by_)"


_PLANAR = f"""{oracle.SEGMENTS}, s AS (SELECT DISTINCT label // {SCENE} AS scene, label, ord, ax, ay, bx, by_ FROM seg WHERE ax <> bx OR ay <> by_),
  c AS (SELECT p.scene, p.label, p.ord, p.ax, p.ay, CAST((p.bx - p.ax) * {_UP} * sign({_DOWN}) AS HUGEINT) AS ox, CAST((p.by_ - p.ay) * {_UP} * sign({_DOWN}) AS HUGEINT) AS oy, CAST(abs({_DOWN}) AS HUGEINT) AS d FROM s p JOIN s q ON p.scene = q.scene WHERE {_SIGNS}),
  m AS (SELECT *, ((ox % d) + d) % d AS mx, ((oy % d) + d) % d AS my FROM c),
  cut AS (SELECT scene, label, ord, CAST(ax + (ox - mx) // d AS BIGINT) AS x, CAST(mx * 1000000000000000000 // d AS BIGINT) AS xp, CAST(ay + (oy - my) // d AS BIGINT) AS y, CAST(my * 1000000000000000000 // d AS BIGINT) AS yp FROM m UNION {_touch('a')} UNION {_touch('b')}),
  step AS (SELECT scene, x AS ux, xp AS uxp, y AS uy, yp AS uyp, lead(x) OVER w AS vx, lead(xp) OVER w AS vxp, lead(y) OVER w AS vy, lead(yp) OVER w AS vyp FROM cut WINDOW w AS (PARTITION BY label, ord ORDER BY x, xp, y, yp))"""


@query(f"WITH {_PLANAR} SELECT DISTINCT * FROM step WHERE vx IS NOT NULL")
def planar_graph(spark, sf_dir):
    """The polylines of each scene as a planar graph over their ends and crossings."""
    return crossing.planar_graph(_scenes(spark, sf_dir), ["label", "ord"], "scene", views.WIDTH)


_P = [f"{p}{i}" for p in "abcd" for i in (1, 2)]


def _far(p: str, q: str) -> str:
    return f"sqrt(({p}1 - {q}1) * ({p}1 - {q}1) + ({p}2 - {q}2) * ({p}2 - {q}2))"


def _turned(p: str, q: str, when: str) -> str:
    return ", ".join(f"CASE WHEN {when} THEN {q}{i} ELSE {p}{i} END AS {p}{i}" for i in (1, 2))


def fit_sql(pairs: str, key: str) -> str:
    """CTEs up to ``box``: the wedges of ``pair`` (key, a1 .. d2 as doubles, crosses) and their march."""
    arm = lambda e: f"{LEAST / 2} / nullif(greatest(abs({e}1 - x1), abs({e}2 - x2)), 0.0)"
    wedge = lambda k, e, m, m2: f"SELECT {key}, {k} AS part, x1 + ({e}1 - x1) * t{e} AS a1, x2 + ({e}2 - x2) * t{e} AS a2, {e}1 AS b1, {e}2 AS b2, x1 + (m{k}1 - x1) * tm{k} AS c1, x2 + (m{k}2 - x2) * tm{k} AS c2, m{k}1 AS d1, m{k}2 AS d2 FROM mate WHERE t{e} < 1 AND tm{k} < 1"
    return f"""{pairs},
  plain0 AS (SELECT *, {_far('a', 'c')} + {_far('b', 'd')} > {_far('a', 'd')} + {_far('b', 'c')} AS across FROM pair WHERE NOT crosses),
  plain1 AS (SELECT {key}, a1, a2, b1, b2, {_turned('c', 'd', 'across')}, {_turned('d', 'c', 'across')} FROM plain0),
  plain2 AS (SELECT *, {_far('b', 'd')} < {_far('a', 'c')} AS turned FROM plain1),
  met AS (SELECT *, a1 + k * (b1 - a1) AS x1, a2 + k * (b2 - a2) AS x2 FROM (SELECT *, ((c1 - a1) * (d2 - c2) - (c2 - a2) * (d1 - c1)) / ((b1 - a1) * (d2 - c2) - (b2 - a2) * (d1 - c1)) AS k FROM pair WHERE crosses)),
  side AS (SELECT *, (a1 - x1) * (c1 - x1) + (a2 - x2) * (c2 - x2) < 0 AS apart FROM met),
  mate0 AS (SELECT *, {', '.join(f'CASE WHEN apart THEN d{i} ELSE c{i} END AS m1{i}, CASE WHEN apart THEN c{i} ELSE d{i} END AS m2{i}' for i in (1, 2))} FROM side),
  mate AS (SELECT *, {arm('a')} AS ta, {arm('b')} AS tb, {arm('m1')} AS tm1, {arm('m2')} AS tm2 FROM mate0),
  wedge AS (SELECT {key}, 0 AS part, {_turned('a', 'b', 'turned')}, {_turned('b', 'a', 'turned')}, {_turned('c', 'd', 'turned')}, {_turned('d', 'c', 'turned')} FROM plain2
    UNION ALL SELECT {key}, 0, x1, x2, x1, x2, x1, x2, x1, x2 FROM met UNION ALL {wedge(1, 'a', 'm1', 'm2')} UNION ALL {wedge(2, 'b', 'm2', 'm1')}),
  sized AS (SELECT *, greatest({_far('a', 'b')}, {_far('c', 'd')}) AS len FROM wedge),
  walk AS (SELECT *, CAST(0 AS INTEGER) AS step, 0.0::DOUBLE AS pos, {_step('0.0::DOUBLE')} FROM sized
    UNION ALL SELECT {key}, part, {', '.join(_P)}, len, step + 1, pos + size, {_step('(pos + size)')} FROM walk WHERE pos + size <= len),
  box AS (SELECT {key}, part, step, round((p1 + q1) / 2, 3) AS x, round((p2 + q2) / 2, 3) AS y, round(size, 3) AS size, round(p1 + (q1 - p1) / 4, 3) AS px, round(p2 + (q2 - p2) / 4, 3) AS py, round(q1 + (p1 - q1) / 4, 3) AS qx, round(q2 + (p2 - q2) / 4, 3) AS qy FROM walk)"""


def _step(at: str) -> str:
    t = f"coalesce({at} / nullif(len, 0.0), 0.0)"
    p = [f"(a{i} + {t} * (b{i} - a{i}))" for i in (1, 2)]
    s = f"greatest(0.0, least(1.0, coalesce((({p[0]} - c1) * (d1 - c1) + ({p[1]} - c2) * (d2 - c2)) / nullif((d1 - c1) * (d1 - c1) + (d2 - c2) * (d2 - c2), 0.0), 0.0)))"
    q = [f"(c{i} + {s} * (d{i} - c{i}))" for i in (1, 2)]
    gap = f"sqrt(({p[0]} - {q[0]}) * ({p[0]} - {q[0]}) + ({p[1]} - {q[1]}) * ({p[1]} - {q[1]}))"
    return f"{p[0]} AS p1, {p[1]} AS p2, {q[0]} AS q1, {q[1]} AS q2, greatest({gap}, {LEAST}) AS size"


_CROSSED = f"{oracle.SEGMENTS}, s AS (SELECT label // {SCENE} AS scene, * FROM seg), pair AS (SELECT p.label, p.ord, q.label AS q_label, q.ord AS q_ord, " + ", ".join(f"CAST({t}.{c} AS DOUBLE) AS {n}" for n, (t, c) in zip(_P, [(t, c) for t in "pq" for c in ("ax", "ay", "bx", "by_")], strict=True)) + f", true AS crosses FROM s p JOIN s q ON p.scene = q.scene AND p.label < q.label WHERE {_SIGNS})"
_NEXT = f"{oracle.SEGMENTS}, nxt AS (SELECT *, lead(ax, 2) OVER w AS cx, lead(ay, 2) OVER w AS cy, lead(bx, 2) OVER w AS dx, lead(by_, 2) OVER w AS dy FROM seg WINDOW w AS (PARTITION BY label ORDER BY ord)), pair AS (SELECT label, ord, " + ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, c in zip(_P, ("ax", "ay", "bx", "by_", "cx", "cy", "dx", "dy"), strict=True)) + ", " + _SIGNS.replace("q.ax", "cx").replace("q.ay", "cy").replace("q.bx", "dx").replace("q.by_", "dy").replace("p.", "") + " AS crosses FROM nxt WHERE cx IS NOT NULL)"


def _rounded(boxes: DataFrame) -> DataFrame:
    return boxes.select(*[F.round(c, 3).alias(c) if c in ("x", "y", "size", "px", "py", "qx", "qy") else F.col(c) for c in boxes.columns])


@query(f"WITH RECURSIVE {fit_sql(_NEXT, 'label, ord')} SELECT * FROM box")
def fit_boxes(spark, sf_dir):
    """Boxes between each segment and the next but one of its polyline."""
    return _rounded(fitting.fit_boxes(fitting.neighbour_pairs(views.segments(spark, sf_dir)), LEAST))


@query(f"WITH RECURSIVE {fit_sql(_CROSSED, 'label, ord, q_label, q_ord')} SELECT * FROM box")
def fit_boxes_crossing(spark, sf_dir):
    """Boxes in the wedges of segments that cross within their scene."""
    pairs = crossing.meeting_pairs(_scenes(spark, sf_dir), ["label", "ord"], "label", "scene", proper=True)
    names = {"p_label": "label", "p_ord": "ord", "q_label": "q_label", "q_ord": "q_ord"} | {f"{s}_{e}{a}": to + a for s, e, to in (("p", "a", "a"), ("p", "b", "b"), ("q", "a", "c"), ("q", "b", "d")) for a in "xy"}
    return _rounded(fitting.fit_boxes(pairs.select(*[F.col(k).alias(v) for k, v in names.items()]), LEAST))


@query()
def refined_radix_cells(spark, sf_dir):
    """Leaf cells that polylines meet in the radix tree over their points, refined until only unit cells hold several labels; held against that in the tests."""
    segs = write_and_reread(views.segments(spark, sf_dir, SMALL.width), "segments")
    ends = segs.select(F.explode(F.array(*[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"])).alias("p"))
    return refine.refine(ends.select("p.*"), segs, SMALL)[1]


_PAIRS = f"""{oracle.GVD}, face AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, CASE WHEN la < lb THEN len ELSE -len END AS n, axis, len FROM gvd),
  ranged AS (SELECT *, min(len) OVER w AS low, max(len) OVER w AS high FROM face WINDOW w AS (PARTITION BY a, b)),
  rated AS (SELECT *, coalesce(pow(1 - (len - low) / nullif(CAST(high - low AS DOUBLE), 0.0), 2), 1.0) AS w FROM ranged),
  att AS (SELECT a, b, sum(CASE WHEN axis = 0 THEN w * n ELSE 0.0 END) AS nx, sum(CASE WHEN axis = 1 THEN w * n ELSE 0.0 END) AS ny, CAST(sum(len) AS DOUBLE) AS area FROM rated GROUP BY a, b),
  dir AS (SELECT a AS u, b AS v, nx, ny, area FROM att UNION ALL SELECT b, a, -nx, -ny, area FROM att)"""
_OFFSETS = f"""{_PAIRS}, walk AS (SELECT min(u) AS node, 0 AS hops FROM dir UNION SELECT v, hops + 1 FROM walk JOIN dir ON u = node WHERE hops < 8),
  ring AS (SELECT node AS label, min(hops) AS ring FROM walk GROUP BY node),
  off_ AS (SELECT 0 AS ring, label, 0.0::DOUBLE AS ox, 0.0::DOUBLE AS oy FROM ring WHERE ring = 0
    UNION ALL SELECT ring, label, coalesce(32.0 * ring * sx / nullif(sqrt(sx * sx + sy * sy), 0.0), 0.0), coalesce(32.0 * ring * sy / nullif(sqrt(sx * sx + sy * sy), 0.0), 0.0)
      FROM (SELECT o.ring + 1 AS ring, d.v AS label, sum(CASE WHEN o.ring = 0 THEN d.nx ELSE o.ox * d.area END) AS sx, sum(CASE WHEN o.ring = 0 THEN d.ny ELSE o.oy * d.area END) AS sy FROM off_ o JOIN dir d ON d.u = o.label JOIN ring r ON r.label = d.v AND r.ring = o.ring + 1 GROUP BY o.ring, d.v))"""


def _pairs(spark, sf_dir) -> DataFrame:
    """Directions and areas of the labels that meet in the plane's diagram, from its points on the lattice's edges."""
    points = write_and_reread(gvd_points(spark, sf_dir)[1], "gvd-points")
    way = F.when(F.col("la") < F.col("lb"), F.col("len")).otherwise(-F.col("len"))
    n = [F.when(F.col("axis") == k, way).otherwise(0).alias(f"n{a}") for k, a in enumerate("xyz")]
    return gvd.pair_attributes(points.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), *n, F.col("len").alias("dist"), F.col("len").alias("area")), 2)


def _offsets(pairs: DataFrame) -> DataFrame:
    return explode.explode_offsets(pairs, pairs.agg(F.min("a")).first()[0], 32.0)


@query(f"WITH RECURSIVE {_PAIRS} SELECT a, b, round(nx, 4) AS nx, round(ny, 4) AS ny, round(area, 4) AS area FROM att")
def label_pair_attributes(spark, sf_dir):
    """Direction and extent of the border of each pair of labels."""
    return _pairs(spark, sf_dir).select("a", "b", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("nx", "ny", "area")])


@query(f"WITH RECURSIVE {_OFFSETS} SELECT label, ring, round(ox, 3) + 0.0 AS ox, round(oy, 3) + 0.0 AS oy FROM off_")
def explode_offsets(spark, sf_dir):
    """Each label's offset away from the first one, ring by ring."""
    found = _offsets(write_and_reread(_pairs(spark, sf_dir), "pairs"))
    return found.select("label", "ring", *[(F.round(c, 3) + 0.0).alias(c) for c in ("ox", "oy")])


@query(f"WITH RECURSIVE {_OFFSETS}, far AS (SELECT least(200, CAST(min(area) AS BIGINT) * 7 // 10) AS step FROM att), way AS (SELECT label, coalesce(ox / nullif(sqrt(ox * ox + oy * oy), 0.0) * step, 0.0) AS mx, coalesce(oy / nullif(sqrt(ox * ox + oy * oy), 0.0) * step, 0.0) AS my FROM off_, far), v AS (SELECT label, ax AS x, ay AS y FROM seg UNION ALL SELECT label, bx, by_ FROM seg) SELECT v.label, round(min(x + coalesce(mx, 0.0)), 3) AS min_x, round(max(x + coalesce(mx, 0.0)), 3) AS max_x, round(min(y + coalesce(my, 0.0)), 3) AS min_y, round(max(y + coalesce(my, 0.0)), 3) AS max_y FROM v LEFT JOIN way USING (label) GROUP BY v.label")
def exploded_boxes(spark, sf_dir):
    """Boxes of the polylines after one step of the exploded view, as far as the shortest border allows."""
    pairs = write_and_reread(_pairs(spark, sf_dir), "pairs")
    ends = views.segments(spark, sf_dir).select("label", F.explode(F.array(*[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y"), F.lit(0).alias("z")) for e in "ab"])).alias("p")).select("label", "p.*")
    out = explode.moved(ends, _offsets(pairs), explode.explode_step(pairs, "area", 200))
    box = out.groupBy("label").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    return box.select("label", *[F.round(c, 3).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


_RING_KEY = "normal, fx, fy, fz, w"


def _branch_sql(rounds: int) -> str:
    """Rings of points around faces, joined round by round with window functions."""
    place = lambda a, b: f"CASE WHEN q{b} - f{b} = 0 THEN q{a} - f{a} WHEN q{a} - f{a} = w THEN w + (q{b} - f{b}) WHEN q{b} - f{b} = w THEN 3 * w - (q{a} - f{a}) ELSE 4 * w - (q{b} - f{b}) END"
    size2 = lambda p, q: " + ".join(f"({p[i]} - {q[i]}) * ({p[i]} - {q[i]})" for i in range(3))
    own, nxt, mid = ["px", "py_", "pz"], ["nx", "ny", "nz"], ["mx", "my", "mz"]
    ctes = [f"ring0 AS MATERIALIZED (SELECT {_RING_KEY}, row_number() OVER (PARTITION BY {_RING_KEY} ORDER BY CASE normal WHEN 0 THEN {place('y', 'z')} WHEN 1 THEN {place('x', 'z')} ELSE {place('x', 'y')} END, qx, qy, qz, la, lb) - 1 AS i, count(*) OVER (PARTITION BY {_RING_KEY}) AS n, qx AS px, qy AS py_, qz AS pz, la, lb FROM rim)"]
    lines = [f"SELECT {_RING_KEY}, la, lb, px AS ax, py_ AS ay, pz AS az, nx AS bx, ny AS by_, nz AS bz FROM (SELECT *, lead(px) OVER k AS nx, lead(py_) OVER k AS ny, lead(pz) OVER k AS nz FROM ring0 WHERE n = 2 WINDOW k AS (PARTITION BY {_RING_KEY} ORDER BY i)) WHERE i = 0"]
    for r in range(rounds):
        key = " AND ".join(f"a.{c} = b.{c}" for c in _RING_KEY.split(", "))
        ctes += [
            f"next{r} AS (SELECT *, " + ", ".join(f"coalesce(lead({c}) OVER k, first_value({c}) OVER k) AS {d}" for c, d in zip((*own, "la", "lb"), (*nxt, "na", "nb"), strict=True)) + f" FROM ring{r} WHERE n > 2 WINDOW k AS (PARTITION BY {_RING_KEY} ORDER BY i))",
            f"near{r} AS MATERIALIZED (SELECT * FROM next{r} QUALIFY row_number() OVER (PARTITION BY {_RING_KEY} ORDER BY {size2(own, nxt)}, i) = 1)",
            f"far{r} AS MATERIALIZED (SELECT a.*, b.i AS o, b.px AS ox, b.py_ AS oy, b.pz AS oz, b.nx, b.ny, b.nz, b.la AS pa, b.lb AS pb, b.na, b.nb FROM ring{r} a JOIN near{r} b ON {key} QUALIFY row_number() OVER (PARTITION BY {', '.join('a.' + c for c in _RING_KEY.split(', '))} ORDER BY {size2(['a.px', 'a.py_', 'a.pz'], ['b.px', 'b.py_', 'b.pz'])} DESC, a.i) = 1)",
            f"mid{r} AS MATERIALIZED (SELECT *, (ox + nx + px) / 3 AS mx, (oy + ny + py_) / 3 AS my, (oz + nz + pz) / 3 AS mz FROM far{r})",
            f"ring{r + 1} AS MATERIALIZED (SELECT {_RING_KEY}, row_number() OVER (PARTITION BY {_RING_KEY} ORDER BY i) - 1 AS i, n - 1 AS n, px, py_, pz, la, lb FROM (SELECT a.{', a.'.join(_RING_KEY.split(', '))}, a.i, a.n, " + ", ".join(f"CASE WHEN a.i = b.o THEN b.{m} ELSE a.{c} END AS {c}" for m, c in zip(mid, own, strict=True)) + f", a.la, a.lb FROM ring{r} a JOIN mid{r} b ON {key} WHERE a.n > 3 AND a.i <> (b.o + 1) % a.n))",
        ]
        lines += [f"SELECT {_RING_KEY}, pa, pb, ox, oy, oz, mx, my, mz FROM mid{r}", f"SELECT {_RING_KEY}, na, nb, nx, ny, nz, mx, my, mz FROM mid{r}"]
        lines.append(f"SELECT {', '.join('a.' + c for c in _RING_KEY.split(', '))}, a.la, a.lb, a.px, a.py_, a.pz, b.mx, b.my, b.mz FROM ring{r} a JOIN mid{r} b ON {key} WHERE a.n = 3 AND a.i <> b.o AND a.i <> (b.o + 1) % 3")
    return ", ".join(ctes) + ", line_ AS (" + " UNION ALL ".join(lines) + ")"


_ROUND6 = ", ".join(f"round({e}, 3) AS {n}" for e, n in (("ax", "ax"), ("ay", "ay"), ("az", "az"), ("bx", "bx"), ("by_", "b_y"), ("bz", "bz")))


@query(f"WITH {oracle.GVD3}, {_branch_sql(10)} SELECT normal, fx, fy, fz, CAST(w AS BIGINT) AS w, la, lb, {_ROUND6} FROM line_")
def gvd_face_branches_3d(spark, sf_dir):
    """The points where surfaces cut the rims of shared faces, joined by branching at closest pairs."""
    leaves, points = surface_parts(spark, sf_dir)
    made = branches.face_branches(gvd.face_rims(points, leaves, TREE3))
    return made.select("normal", "fx", "fy", "fz", "w", "la", "lb", *[F.round(c, 3).alias("b_y" if c == "by" else c) for c in ("ax", "ay", "az", "bx", "by", "bz")])


def _ends_sql() -> str:
    parts = []
    for k, (c, o) in enumerate((("x", "y"), ("y", "x"))):
        col = lambda e, a: f"{e}{a}" + "_" * (e + a == "by")
        d = f"nullif(CAST({col('b', c)} - {col('a', c)} AS DOUBLE), 0.0)"
        for step in (0, 1):
            bound = f"(c{c} + {step}) * {SIDE}"
            other = f"({col('a', o)} + (({col('b', o)} - {col('a', o)}) * ({bound} - {col('a', c)})) / {d})"
            p = (f"CAST({bound} AS DOUBLE)", other)
            parts.append(f"SELECT label, ord, cx, cy, ax, ay, bx, by_, {p[k]} AS x, {p[1 - k]} AS y FROM cell WHERE ({bound} - {col('a', c)}) / {d} BETWEEN 0 AND 1 AND {other} BETWEEN c{o} * {SIDE} AND (c{o} + 1) * {SIDE}")
    return " UNION ".join(parts)


@query(f"WITH {oracle.SEGMENTS}, {oracle.cells(SIDE, COUNT)}, place AS ({_ends_sql()}), turn AS (SELECT *, CASE WHEN bx > ax OR (bx = ax AND by_ > ay) THEN 1 ELSE -1 END AS f FROM place), seq AS (SELECT *, row_number() OVER (PARTITION BY label, ord, cx, cy ORDER BY f * x, f * y) AS i, count(*) OVER (PARTITION BY label, ord, cx, cy) AS n FROM turn), two AS (SELECT p.label, p.ord, p.cx, p.cy, p.n, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM seq p JOIN seq q ON p.label = q.label AND p.ord = q.ord AND p.cx = q.cx AND p.cy = q.cy AND p.i < q.i QUALIFY row_number() OVER (PARTITION BY p.label, p.ord, p.cx, p.cy ORDER BY round(abs((q.x - p.x) * (p.bx - p.ax) + (q.y - p.y) * (p.by_ - p.ay)) / nullif(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) * sqrt(CAST((p.bx - p.ax) * (p.bx - p.ax) + (p.by_ - p.ay) * (p.by_ - p.ay) AS DOUBLE)), 0.0), 9) DESC NULLS LAST, p.i, q.i) = 1) SELECT c.label, c.ord, c.cx, c.cy, CAST(coalesce(two.n, s.n, 0) AS INTEGER) AS n, round(coalesce(x0, s.x), 4) AS x0, round(coalesce(y0, s.y), 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM cell c LEFT JOIN two USING (label, ord, cx, cy) LEFT JOIN (SELECT * FROM seq WHERE n = 1) s USING (label, ord, cx, cy)")
def cell_ends_2d(spark, sf_dir):
    """Where each segment meets the sides of each cell that it is in; of several places the two that agree best with its direction."""
    found = branches.cell_ends(spatial.segment_cells(views.segments(spark, sf_dir), SIDE, COUNT), SIDE)
    return found.select("label", "ord", "cx", "cy", "n", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query()
def subdivided_labels(spark, sf_dir):
    """Closest points on the lattice after ambiguous leaves were split, spread from the new edges only; held against a whole relaxation in the tests."""
    leaves, bridge = octree.adaptive_leaves(views.segments(spark, sf_dir).drop("ord"), views.TREE)
    return wave.subdivide_ambiguous(leaves, bridge, views.TREE)[2][2]


@query()
def gvd_pipeline_2d(spark, sf_dir):
    """The plane's diagram from end to end: tree, relaxation, subdivision, points and lines; lines of each pair of labels."""
    leaves, bridge = octree.adaptive_leaves(views.segments(spark, sf_dir).drop("ord"), views.TREE)
    leaves, _, (_, edges, labels) = wave.subdivide_ambiguous(leaves, bridge, views.TREE)
    points = write_and_reread(gvd.edge_points(edges, labels), "gvd-points")
    return gvd.cell_lines(points, leaves, views.TREE).groupBy("la", "lb").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.hypot(F.col("qx") - F.col("mx"), F.col("qy") - F.col("my"))), 2).alias("length"))


@query()
def gvd_pipeline_3d(spark, sf_dir):
    """The diagram in space from end to end: tree, relaxation, subdivision, face lines and triangles; triangles of each pair of labels."""
    leaves, bridge = octree.adaptive_leaves(triangle_prims(spark, sf_dir), TREE3)
    leaves, _, (_, edges, labels) = wave.subdivide_ambiguous(leaves, bridge, TREE3)
    points = write_and_reread(gvd.edge_points(edges, labels, 3), "gvd-points")
    made = gvd.cell_triangles(write_and_reread(gvd.face_fragments(points, leaves, TREE3), "gvd-lines"))
    return made.groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))


def _bases_sql() -> str:
    inside = " AND ".join(f"v.{a} BETWEEN l.c{a} * l.w AND (l.c{a} + 1) * l.w" for a in "xyz")
    mask = " + ".join(f"CASE WHEN v.{a} > l.c{a} * l.w THEN {1 << i} ELSE 0 END" for i, a in enumerate("xyz"))
    return f"held AS MATERIALIZED (SELECT v.x, v.y, v.z, {mask} AS d, {' + '.join(f'(v.{a} - l.c{a} * l.w)' for a in 'xyz')} AS dist, l.w, l.level, l.cx, l.cy, l.cz FROM vert v JOIN leafbox l ON {inside})"


def _lookup_sql() -> str:
    parts = []
    for n in range(3):
        others = [(n + 1) % 3, (n + 2) % 3]
        sides = {a: [(1 << (a + 1) % 3, 1), (1 << (a + 2) % 3, 1), (1 << (a + 1) % 3 | 1 << (a + 2) % 3, 2)] for a in others}
        within = {a: f"EXISTS (SELECT 1 FROM held h WHERE h.x = v.x AND h.y = v.y AND h.z = v.z AND ({' OR '.join(f'(h.d = {d} AND h.dist < h.w * {f})' for d, f in sides[a])}))" for a in others}
        tries = f"CASE k.d WHEN {1 << n} THEN 0 WHEN {1 << n | 1 << others[0]} THEN CASE WHEN s{others[0]} THEN NULL ELSE 1 END WHEN {1 << n | 1 << others[1]} THEN CASE WHEN s{others[1]} THEN NULL ELSE 2 END WHEN 7 THEN 3 END"
        parts.append(f"SELECT x, y, z, {n} AS normal, far, min(o) AS o, arg_min(level, o) AS level, arg_min(cx, o) AS cx, arg_min(cy, o) AS cy, arg_min(cz, o) AS cz, count(*) AS n_bases FROM (SELECT v.*, k.level, k.cx, k.cy, k.cz, {tries} AS o FROM (SELECT v.x, v.y, v.z, {', '.join(f'{within[a]} AS s{a}' for a in others)}, EXISTS (SELECT 1 FROM held h WHERE h.x = v.x AND h.y = v.y AND h.z = v.z AND h.d = {1 << n} AND h.dist = h.w) AS far FROM vert v) v JOIN held k ON k.x = v.x AND k.y = v.y AND k.z = v.z) GROUP BY x, y, z, far")
    return " UNION ALL ".join(parts)


@query(f"WITH {oracle.tree3()}, {oracle.VERTICES3}, {_bases_sql()}, found AS ({_lookup_sql()}) SELECT x, y, z, normal, far, level, cx, cy, cz, n_bases FROM found")
def vertex_bases_3d(spark, sf_dir):
    """The leaf that every lattice vertex falls to along each axis, by the order of its fallbacks, and whether it is on that leaf's far side."""
    leaves = octree.adaptive_cells(triangle_prims(spark, sf_dir), TREE3)
    wide = write_and_reread(bases.by_direction(bases.bases(octree.leaf_vertices(leaves, TREE3), leaves, TREE3), TREE3), "vertex-bases")
    count = sum((F.when(bases.has_base(d), 1).otherwise(0) for d in range(8)), F.lit(0)).cast("long").alias("n_bases")
    rows = [F.struct(F.lit(n).alias("normal"), bases.on_boundary(n).alias("far"), bases.base_with_fallbacks(n).alias("b")) for n in range(3)]
    return wide.select("x", "y", "z", count, F.explode(F.array(*rows)).alias("r")).select("x", "y", "z", "r.normal", "r.far", "r.b.level", "r.b.cx", "r.b.cy", "r.b.cz", "n_bases")


def _next_sql() -> str:
    parts = []
    for i, (a, b) in enumerate((("x", "y"), ("y", "x"))):
        gap = f"coalesce(sum(CASE WHEN e.len IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY v.{b} ORDER BY v.{a} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        runs = f"(SELECT v.x, v.y, {gap} AS run, EXISTS (SELECT 1 FROM leafbox l WHERE l.cx * l.w = v.x AND l.cy * l.w = v.y) AS base FROM vert v LEFT JOIN edge e ON e.x = v.x AND e.y = v.y AND e.axis = {i})"
        parts.append(f"SELECT x, y, {i} AS axis, {a} - max(CASE WHEN base THEN {a} END) OVER (PARTITION BY {b}, run ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back, min(CASE WHEN base THEN {a} END) OVER (PARTITION BY {b}, run ORDER BY {a} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - {a} AS ahead FROM {runs}")
    return " UNION ALL ".join(parts)


@query(f"WITH {oracle.tree()}, {oracle.VERTICES}, {oracle.EDGES} {_next_sql()}")
def next_base_2d(spark, sf_dir):
    """How far each lattice vertex can walk along the leaves' sides to the next corner where a leaf begins."""
    leaves = octree.adaptive_cells(views.segments(spark, sf_dir).drop("ord"), views.TREE)
    vertices = write_and_reread(octree.leaf_vertices(leaves, views.TREE), "vertices")
    edges = write_and_reread(octree.leaf_edges(vertices, leaves, views.TREE), "edges")
    return bases.next_base(vertices, edges, leaves, views.TREE)


_FIELD = f"pix AS (SELECT a.v * {views.WIDTH // 64} AS x, b.v * {views.WIDTH // 64} AS y FROM (SELECT unnest(range(0, 65)) AS v) a, (SELECT unnest(range(0, 65)) AS v) b), spot AS (SELECT p.x, p.y, l.level, l.w, (l.cx + i) * l.w AS vx, (l.cy + j) * l.w AS vy, (CASE i WHEN 1 THEN (p.x - l.cx * l.w) / CAST(l.w AS DOUBLE) ELSE 1 - (p.x - l.cx * l.w) / CAST(l.w AS DOUBLE) END) * (CASE j WHEN 1 THEN (p.y - l.cy * l.w) / CAST(l.w AS DOUBLE) ELSE 1 - (p.y - l.cy * l.w) / CAST(l.w AS DOUBLE) END) AS k FROM pix p JOIN leafbox l ON least(p.x, {views.WIDTH - 1}) // l.w = l.cx AND least(p.y, {views.WIDTH - 1}) // l.w = l.cy, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"


@query(f"WITH {oracle.tree()}, {oracle.VERTICES}, {oracle.nearest('vert')}, {_FIELD} SELECT s.x, s.y, s.level, round(sum(k * sqrt(d2)), 4) AS field FROM spot s JOIN near n ON n.x = s.vx AND n.y = s.vy GROUP BY s.x, s.y, s.level")
def distance_field_leaves(spark, sf_dir):
    """A raster of distances, interpolated inside the tree's leaves from their corners."""
    leaves = octree.adaptive_cells(views.segments(spark, sf_dir).drop("ord"), views.TREE)
    near = nearest_segment(octree.leaf_vertices(leaves, views.TREE), views.segments(spark, sf_dir))
    values = write_and_reread(near.select("x", "y", F.sqrt("d2").alias("value")), "field-values")
    return gvd.leaf_field(gvd.raster(spark, views.WIDTH, 64), leaves, values, views.TREE).withColumn("field", F.round("field", 4))


@query(f"WITH {oracle.tree()} SELECT level, cx, cy, CAST(n_labels AS INTEGER) AS n_labels FROM leaf")
def leaf_files(spark, sf_dir):
    """The tree's leaves, written as lines of octants and read back."""
    leaves = octree.adaptive_cells(views.segments(spark, sf_dir).drop("ord"), views.TREE)
    path = scratch_path(spark, "leaf-lines")
    tree_files.write_leaves(leaves, path, 2, "n_labels")
    return tree_files.read_leaves(spark, path, 2, "n_labels")
