"""DuckDB SQL of the registered geometry queries, written without the engine's operators."""

from __future__ import annotations

WIDTH, LEVELS = 4096, 6

POINTS = "points2 AS (SELECT DISTINCT l_quantity * 2000 AS fx, l_extendedprice AS fy, CAST(l_suppkey % 4 AS INTEGER) AS label FROM lineitem)"


def lattice(width: int) -> str:
    return f"""{POINTS}, box AS (SELECT min(fx) AS x0, min(fy) AS y0, greatest(max(fx) - min(fx), max(fy) - min(fy)) AS ext FROM points2),
    pts AS (SELECT fx, fy, label, CAST(floor({width - 1} * ((fx - x0) / ext) + 0.5) AS BIGINT) AS x, CAST(floor({width - 1} * ((fy - y0) / ext) + 0.5) AS BIGINT) AS y FROM points2, box)"""


def morton(bits: int, x: str = "x", y: str = "y") -> str:
    return " | ".join(f"((({c} >> {i}) & 1) << {2 * i + j})" for i in range(bits) for j, c in enumerate((x, y)))


def codes(width: int) -> str:
    return f"{lattice(width)}, codes AS (SELECT DISTINCT {morton(width.bit_length() - 1)} AS z FROM pts)"


POLY = "poly AS (SELECT user_id AS label, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ord, epoch_us(ts) // 1000000 - 1704067200 AS fx, value * 8000 AS fy FROM events)"

SEGMENTS = f"""{POLY}, pbox AS (SELECT min(fx) AS x0, min(fy) AS y0, greatest(max(fx) - min(fx), max(fy) - min(fy)) AS ext FROM poly),
    placed AS (SELECT label, ord, CAST(floor({WIDTH - 1} * ((fx - x0) / ext) + 0.5) AS BIGINT) AS x, CAST(floor({WIDTH - 1} * ((fy - y0) / ext) + 0.5) AS BIGINT) AS y FROM poly, pbox),
    led AS (SELECT label, ord, x AS ax, y AS ay, lead(x) OVER (PARTITION BY label ORDER BY ord) AS bx, lead(y) OVER (PARTITION BY label ORDER BY ord) AS by_ FROM placed),
    seg AS (SELECT * FROM led WHERE bx IS NOT NULL)"""


def _side(x: str, y: str) -> str:
    return f"((bx - ax) * ({y} - ay) - (by_ - ay) * ({x} - ax))"


def seg_box(x0: str, y0: str, x1: str, y1: str) -> str:
    sides = ", ".join(_side(x, y) for x in (x0, x1) for y in (y0, y1))
    return f"least(ax, bx) <= {x1} AND greatest(ax, bx) >= {x0} AND least(ay, by_) <= {y1} AND greatest(ay, by_) >= {y0} AND least({sides}) <= 0 AND greatest({sides}) >= 0"


def cells(side: int, count: int, name: str = "cell") -> str:
    """Every segment with each closed grid cell that it meets."""

    def span(a: str, b: str) -> str:
        return f"generate_series(greatest(CAST(ceil(least({a}, {b}) / {side}) AS BIGINT) - 1, 0), least(CAST(floor(greatest({a}, {b}) / {side}) AS BIGINT), {count - 1}))"

    box = seg_box(f"cx * {side}", f"cy * {side}", f"(cx + 1) * {side}", f"(cy + 1) * {side}")
    return f"{name} AS (SELECT label, ord, ax, ay, bx, by_, cx, cy FROM (SELECT *, unnest({span('ay', 'by_')}) AS cy FROM (SELECT *, unnest({span('ax', 'bx')}) AS cx FROM seg)) WHERE {box})"


def tree() -> str:
    """Leaves of the label-adaptive tree in closed form: children of split cells that are not split."""
    parts = [SEGMENTS]
    for level in range(LEVELS + 1):
        parts.append(cells(WIDTH >> level, 1 << level, f"c{level}"))
        parts.append(f"n{level} AS (SELECT cx, cy, count(DISTINCT label) AS n FROM c{level} GROUP BY cx, cy)")
    leaves = ["SELECT 0 AS level, cx, cy, n AS n_labels FROM n0 WHERE n < 2"]
    for level in range(1, LEVELS + 1):
        kids = f"(SELECT cx * 2 + dx AS cx, cy * 2 + dy AS cy FROM n{level - 1}, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy) WHERE n >= 2)"
        limit = "" if level == LEVELS else " WHERE coalesce(n, 0) < 2"
        leaves.append(f"SELECT {level} AS level, k.cx, k.cy, coalesce(n, 0) AS n_labels FROM {kids} k LEFT JOIN n{level} m ON k.cx = m.cx AND k.cy = m.cy{limit}")
    parts.append("leaf AS (" + " UNION ALL ".join(leaves) + ")")
    parts.append(f"leafbox AS (SELECT *, {WIDTH} >> level AS w FROM leaf)")
    return ", ".join(parts)


def balanced() -> str:
    """Leaves of the coarsest tree over the split cells in which touching leaves differ by a level at most.

    From the finest level up: a cell has to be split if one of its children is, or one that touches such a child's side or corner.
    """
    parts = [SEGMENTS]
    for level in range(LEVELS + 1):
        parts.append(cells(WIDTH >> level, 1 << level, f"c{level}"))
        parts.append(f"n{level} AS (SELECT cx, cy, count(DISTINCT label) AS n FROM c{level} GROUP BY cx, cy)")
    parts.append(f"s{LEVELS - 1} AS (SELECT cx, cy FROM n{LEVELS - 1} WHERE n >= 2)")
    for level in range(LEVELS - 2, -1, -1):
        top = (2 << level) - 1
        around = f"SELECT DISTINCT (cx + dx) // 2 AS cx, (cy + dy) // 2 AS cy FROM s{level + 1}, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy) WHERE cx + dx BETWEEN 0 AND {top} AND cy + dy BETWEEN 0 AND {top}"
        parts.append(f"s{level} AS (SELECT cx, cy FROM n{level} WHERE n >= 2 UNION {around})")
    leaves = ["SELECT 0 AS level, cx, cy, n AS n_labels FROM n0 WHERE (cx, cy) NOT IN (SELECT (cx, cy) FROM s0)"]
    for level in range(1, LEVELS + 1):
        kids = f"(SELECT cx * 2 + dx AS cx, cy * 2 + dy AS cy FROM s{level - 1}, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy))"
        limit = "" if level == LEVELS else f" WHERE NOT EXISTS (SELECT 1 FROM s{level} s WHERE s.cx = k.cx AND s.cy = k.cy)"
        leaves.append(f"SELECT {level} AS level, k.cx, k.cy, coalesce(n, 0) AS n_labels FROM {kids} k LEFT JOIN n{level} m ON k.cx = m.cx AND k.cy = m.cy{limit}")
    return "WITH " + ", ".join(parts) + " SELECT level, cx, cy, CAST(n_labels AS INTEGER) AS n_labels FROM (" + " UNION ALL ".join(leaves) + ")"


VERTICES = "vert AS (SELECT (cx + dx) * w AS x, (cy + dy) * w AS y, max(level) AS level FROM leafbox, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy) GROUP BY 1, 2)"

EDGES = """step0 AS (SELECT x, y, lead(x) OVER (PARTITION BY y ORDER BY x) - x AS len FROM vert),
    step1 AS (SELECT x, y, lead(y) OVER (PARTITION BY x ORDER BY y) - y AS len FROM vert),
    edge AS (SELECT x, y, 0 AS axis, len FROM step0 s WHERE len IS NOT NULL AND EXISTS (SELECT 1 FROM leafbox WHERE (s.y = cy * w OR s.y = (cy + 1) * w) AND s.x >= cx * w AND s.x + s.len <= (cx + 1) * w)
      UNION ALL SELECT x, y, 1 AS axis, len FROM step1 s WHERE len IS NOT NULL AND EXISTS (SELECT 1 FROM leafbox WHERE (s.x = cx * w OR s.x = (cx + 1) * w) AND s.y >= cy * w AND s.y + s.len <= (cy + 1) * w))"""


def nearest(queries: str, name: str = "near") -> str:
    """Nearest segment of each (x, y) in ``queries`` by brute force."""
    n = "nullif(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE), 0.0)"
    t = f"coalesce(greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / {n})), 0.0)"
    return f"""{name}_all AS (SELECT x, y, label, ax + {t} * (bx - ax) AS qx, ay + {t} * (by_ - ay) AS qy FROM {queries}, seg),
    {name}_d AS (SELECT x, y, label, CAST(floor(qx + 0.5) AS BIGINT) AS px, CAST(floor(qy + 0.5) AS BIGINT) AS py, (x - qx) * (x - qx) + (y - qy) * (y - qy) AS d2 FROM {name}_all),
    {name} AS (SELECT x, y, b.label AS label, b.d2 AS d2, b.px AS px, b.py AS py FROM (SELECT x, y, min({{'d2': d2, 'label': label, 'px': px, 'py': py}}) AS b FROM {name}_d GROUP BY x, y))"""


CROSSED = """gvd AS (SELECT x, y, axis, len, la, lb, x + CASE WHEN axis = 0 THEN s ELSE 0 END AS qx, y + CASE WHEN axis = 1 THEN s ELSE 0 END AS qy FROM (
      SELECT e.x, e.y, e.axis, e.len, p.label AS la, q.label AS lb, coalesce(CASE WHEN (CASE WHEN axis = 0 THEN q.px - p.px ELSE q.py - p.py END) = 0 THEN NULL ELSE
        greatest(0.0, least(CAST(e.len AS DOUBLE), ((e.x - q.px) * (e.x - q.px) + (e.y - q.py) * (e.y - q.py) - (e.x - p.px) * (e.x - p.px) - (e.y - p.py) * (e.y - p.py)) / CAST(2 * (CASE WHEN axis = 0 THEN q.px - p.px ELSE q.py - p.py END) AS DOUBLE))) END, e.len / 2) AS s
      FROM edge e JOIN near p ON p.x = e.x AND p.y = e.y JOIN near q ON q.x = e.x + CASE WHEN e.axis = 0 THEN e.len ELSE 0 END AND q.y = e.y + CASE WHEN e.axis = 1 THEN e.len ELSE 0 END WHERE p.label <> q.label))"""

GVD = ", ".join([tree(), VERTICES, EDGES, nearest("vert"), CROSSED])

POINTS3 = "p3 AS (SELECT vec_id AS vid, label, " + ", ".join(f"CAST(floor((CAST(embedding[{i + 1}] AS DOUBLE) + 1) * 512 + 0.5) AS BIGINT) AS {a}" for i, a in enumerate("xyz")) + " FROM embeddings)"
TRIS = POINTS3 + ", tri AS (SELECT a.vid AS prim_id, a.label AS label, a.vid AS a, b.vid AS b, c.vid AS c, " + ", ".join(f"{s}.{x} AS {t}{x}" for s, t in (("a", "a"), ("b", "b"), ("c", "t")) for x in "xyz") + " FROM p3 a JOIN p3 b ON b.vid = a.vid + 1 JOIN p3 c ON c.vid = a.vid + 2)"
MESH_EDGES = "medge AS (SELECT prim_id, 0 AS side, a AS u, b AS v FROM tri UNION ALL SELECT prim_id, 1, b, c FROM tri UNION ALL SELECT prim_id, 2, c, a FROM tri), mkey AS (SELECT *, least(u, v) AS lo, greatest(u, v) AS hi FROM medge)"


def _normal() -> tuple[str, str, str]:
    d = {f"{p}{a}": f"({q}{a} - a{a})" for p, q in (("u", "b"), ("v", "t")) for a in "xyz"}
    return tuple(f"({d['u' + p]} * {d['v' + q]} - {d['u' + q]} * {d['v' + p]})" for p, q in ("yz", "zx", "xy"))


NORMALS = "norm AS (SELECT *, " + ", ".join(f"{n} AS n{a}" for n, a in zip(_normal(), "xyz", strict=True)) + " FROM tri)"


def tri_cells(side: int, count: int, name: str = "tcell") -> str:
    def span(a: str) -> str:
        own = f"a{a}, b{a}, t{a}"
        return f"unnest(generate_series(greatest(CAST(ceil(least({own}) / {side}) AS BIGINT) - 1, 0), least(CAST(floor(greatest({own}) / {side}) AS BIGINT), {count - 1}))) AS c{a}"

    # doubled coordinates around the cell's centre; half is the cell's side
    moved = ", ".join(f"2 * {p}{a} - (2 * c{a} + 1) * {side} AS {p}{a}" for p in "abt" for a in "xyz")
    pts = {p: [f"{p}{a}" for a in "xyz"] for p in "abt"}
    tests = [f"least(a{a}, b{a}, t{a}) <= {side} AND greatest(a{a}, b{a}, t{a}) >= -{side}" for a in "xyz"]
    edge = [[f"({q}{a} - {p}{a})" for a in "xyz"] for p, q in (("a", "b"), ("b", "t"), ("t", "a"))]
    cross = lambda u, v: [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v, strict=True)) + ")"
    n = cross(edge[0], edge[1])
    tests.append(f"abs({dot(n, pts['a'])}) <= {side} * ({' + '.join(f'abs({x})' for x in n)})")
    for e in edge:
        for axis in (["0", f"-{e[2]}", e[1]], [e[2], "0", f"-{e[0]}"], [f"-{e[1]}", e[0], "0"]):
            own = ", ".join(dot(axis, pts[p]) for p in "abt")
            reach = f"{side} * ({' + '.join(f'abs({x})' for x in axis)})"
            tests.append(f"least({own}) <= {reach} AND greatest({own}) >= -({reach})")
    return f"{name} AS (SELECT prim_id, label, cx, cy, cz FROM (SELECT prim_id, label, cx, cy, cz, {moved} FROM (SELECT *, {span('z')} FROM (SELECT *, {span('y')} FROM (SELECT *, {span('x')} FROM tri)))) WHERE {' AND '.join(tests)})"


GRAPH = "graph AS (SELECT l_suppkey * 2 AS u, l_partkey * 2 + 1 AS v, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2)"
LINKS = GRAPH + ", links AS (SELECT u, v, w FROM graph UNION ALL SELECT v, u, w FROM graph)"


WIDTH3, LEVELS3 = 1024, 4


def tree3() -> str:
    """Leaves of the label-adaptive octree over the triangles, as in ``tree``."""
    parts = [TRIS]
    for level in range(LEVELS3 + 1):
        parts.append(tri_cells(WIDTH3 >> level, 1 << level, f"c{level}"))
        parts.append(f"n{level} AS (SELECT cx, cy, cz, count(DISTINCT label) AS n FROM c{level} GROUP BY cx, cy, cz)")
    leaves = ["SELECT 0 AS level, cx, cy, cz, n AS n_labels FROM n0 WHERE n < 2"]
    for level in range(1, LEVELS3 + 1):
        kids = f"(SELECT cx * 2 + dx AS cx, cy * 2 + dy AS cy, cz * 2 + dz AS cz FROM n{level - 1}, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy), (VALUES (0), (1)) AS c(dz) WHERE n >= 2)"
        limit = "" if level == LEVELS3 else " WHERE coalesce(n, 0) < 2"
        leaves.append(f"SELECT {level} AS level, k.cx, k.cy, k.cz, coalesce(n, 0) AS n_labels FROM {kids} k LEFT JOIN n{level} m ON k.cx = m.cx AND k.cy = m.cy AND k.cz = m.cz{limit}")
    parts.append("leaf AS MATERIALIZED (" + " UNION ALL ".join(leaves) + ")")
    parts.append(f"leafbox AS MATERIALIZED (SELECT *, {WIDTH3} >> level AS w FROM leaf)")
    return ", ".join(parts)


VERTICES3 = "vert AS MATERIALIZED (SELECT (cx + dx) * w AS x, (cy + dy) * w AS y, (cz + dz) * w AS z, max(level) AS level FROM leafbox, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy), (VALUES (0), (1)) AS c(dz) GROUP BY 1, 2, 3)"


def _edges3() -> str:
    """Steps between neighbouring vertices of a line that a side of some leaf covers."""
    steps, edges = [], []
    for i, a in enumerate("xyz"):
        b, c = [o for o in "xyz" if o != a]
        steps.append(f"step{i} AS (SELECT x, y, z, lead({a}) OVER (PARTITION BY {b}, {c} ORDER BY {a}) - {a} AS len FROM vert)")
        sides = f"(SELECT DISTINCT c{a} * w AS lo, (c{a} + 1) * w AS hi, (c{b} + db) * w AS sb, (c{c} + dc) * w AS sc FROM leafbox, (VALUES (0), (1)) AS p(db), (VALUES (0), (1)) AS q(dc))"
        edges.append(f"SELECT DISTINCT s.x, s.y, s.z, {i} AS axis, s.len FROM step{i} s JOIN {sides} t ON t.sb = s.{b} AND t.sc = s.{c} AND s.{a} >= t.lo AND s.{a} + s.len <= t.hi WHERE s.len IS NOT NULL")
    return ", ".join(steps) + ", edge AS MATERIALIZED (" + " UNION ALL ".join(edges) + ")"


EDGES3 = _edges3()


def _triangle_terms() -> dict[str, str]:
    n = _normal()
    plain = {"n2": " + ".join(f"{x} * {x}" for x in n), "lift": " + ".join(f"({a} - a{a}) * {x}" for a, x in zip("xyz", n, strict=True))}
    for p, q in (("a", "b"), ("b", "t"), ("t", "a")):
        e, f = [f"({q}{a} - {p}{a})" for a in "xyz"], [f"({a} - {p}{a})" for a in "xyz"]
        cross = [f"({e[i]} * {f[j]} - {e[j]} * {f[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
        plain[f"side{p}"] = " + ".join(f"{c} * {x}" for c, x in zip(cross, n, strict=True))
    return plain


def edge_foot(p: str, q: str) -> tuple[str, ...]:
    """The point of the edge p-q nearest to (x, y, z)."""
    n = "nullif(CAST(" + " + ".join(f"({q}{a} - {p}{a}) * ({q}{a} - {p}{a})" for a in "xyz") + " AS DOUBLE), 0.0)"
    t = "coalesce(greatest(0.0, least(1.0, (" + " + ".join(f"({a} - {p}{a}) * ({q}{a} - {p}{a})" for a in "xyz") + f") / {n})), 0.0)"
    return tuple(f"{p}{a} + {t} * ({q}{a} - {p}{a})" for a in "xyz")


def foot_distance2(foot: tuple[str, ...]) -> str:
    return " + ".join(f"({a} - ({f})) * ({a} - ({f}))" for a, f in zip("xyz", foot, strict=True))


def nearest3(queries: str, name: str = "near", first: str = "prim_id", second: str = "label") -> str:
    """The nearest triangle's label and point for each (x, y, z) of ``queries``, by brute force."""
    terms = ", ".join(f"{v} AS {k}" for k, v in _triangle_terms().items())
    feet = [edge_foot(p, q) for p, q in (("a", "b"), ("b", "t"), ("t", "a"))]
    far = ", ".join(f"{foot_distance2(f)} AS d{i}" for i, f in enumerate(feet))
    inside = "n2 > 0 AND sidea >= 0 AND sideb >= 0 AND sidet >= 0"
    point = ", ".join(f"CAST(floor(CASE WHEN {inside} THEN {a} - lift / CAST(n2 AS DOUBLE) * {n} WHEN d0 <= d1 AND d0 <= d2 THEN {feet[0][i]} WHEN d1 <= d2 THEN {feet[1][i]} ELSE {feet[2][i]} END + 0.5) AS BIGINT) AS p{a}" for i, (a, n) in enumerate(zip("xyz", _normal(), strict=True)))
    return f"""{name}_all AS (SELECT v.x, v.y, v.z, t.*, {terms}, {far} FROM (SELECT DISTINCT x, y, z FROM {queries}) v, tri t),
    {name}_d AS (SELECT x, y, z, label, prim_id, CASE WHEN {inside} THEN CAST(lift AS DOUBLE) * CAST(lift AS DOUBLE) / CAST(n2 AS DOUBLE) ELSE least(d0, d1, d2) END AS d2, {point} FROM {name}_all),
    {name} AS MATERIALIZED (SELECT x, y, z, b.label AS label, b.d2 AS d2, b.prim_id AS prim_id, b.px AS px, b.py AS py, b.pz AS pz FROM (SELECT x, y, z, min({{'d2': d2, '{first}': {first}, '{second}': {second}, 'px': px, 'py': py, 'pz': pz}}) AS b FROM {name}_d GROUP BY x, y, z))"""


def _pick(values: list[str], by: str = "axis") -> str:
    return f"(CASE {by} WHEN 0 THEN {values[0]} WHEN 1 THEN {values[1]} ELSE {values[2]} END)"


def _crossed3() -> str:
    along = _pick([f"(q.p{a} - p.p{a})" for a in "xyz"])
    far = " + ".join(f"(e.{a} - q.p{a}) * (e.{a} - q.p{a})" for a in "xyz")
    near = " + ".join(f"(e.{a} - p.p{a}) * (e.{a} - p.p{a})" for a in "xyz")
    ends = " AND ".join(f"q.{a} = e.{a} + CASE WHEN e.axis = {i} THEN e.len ELSE 0 END" for i, a in enumerate("xyz"))
    at = ", ".join(f"CAST({a} + CASE WHEN axis = {i} THEN s ELSE 0 END AS DOUBLE) AS q{a}" for i, a in enumerate("xyz"))
    return f"""gvd AS MATERIALIZED (SELECT x, y, z, axis, len, la, lb, {at} FROM (
      SELECT e.x, e.y, e.z, e.axis, e.len, p.label AS la, q.label AS lb, coalesce(CASE WHEN {along} = 0 THEN NULL ELSE greatest(0.0, least(CAST(e.len AS DOUBLE), (({far}) - ({near})) / CAST(2 * {along} AS DOUBLE))) END, e.len / 2) AS s
      FROM edge e JOIN near p ON p.x = e.x AND p.y = e.y AND p.z = e.z JOIN near q ON {ends} WHERE p.label <> q.label))"""


def _faces3() -> str:
    """Faces that two leaves share, the finer first, and the points on their rims."""
    faces, rims = [], []
    for n, c in enumerate("xyz"):
        a, b = [o for o in "xyz" if o != c]
        inside = " AND ".join(f"p.c{o} * p.w >= q.c{o} * q.w AND (p.c{o} + 1) * p.w <= (q.c{o} + 1) * q.w" for o in (a, b))
        cells = ", ".join(f"{s}.{k} AS {s}_{k}" for s in "pq" for k in ("level", "cx", "cy", "cz"))
        for above in (True, False):
            meet = f"(p.c{c} + 1) * p.w = q.c{c} * q.w AND p.w <= q.w" if above else f"p.c{c} * p.w = (q.c{c} + 1) * q.w AND p.w < q.w"
            corner = ", ".join(f"(p.c{o} + {int(above and o == c)}) * p.w AS f{o}" for o in "xyz")
            faces.append(f"SELECT {n} AS normal, {corner}, p.w AS w, {cells} FROM leafbox p JOIN leafbox q ON {meet} AND {inside}")
    for i, a in enumerate("xyz"):
        for n, c in enumerate("xyz"):
            if n != i:
                b = "xyz"[3 - i - n]
                rims.append(f"SELECT f.*, g.x, g.y, g.z, g.axis, g.la, g.lb, g.qx, g.qy, g.qz FROM gvd g JOIN face f ON g.{c} = f.f{c} AND g.axis = {i} AND f.normal = {n} AND g.{a} >= f.f{a} AND g.{a} + g.len <= f.f{a} + f.w AND (g.{b} = f.f{b} OR g.{b} = f.f{b} + f.w)")
    return f"""face AS MATERIALIZED ({' UNION ALL '.join(faces)}), rim AS ({' UNION ALL '.join(rims)}),
    rated AS (SELECT *, count(*) OVER k AS n, row_number() OVER o AS turn, avg(qx) OVER k AS mx, avg(qy) OVER k AS my, avg(qz) OVER k AS mz, lead(qx) OVER o AS lx, lead(qy) OVER o AS ly, lead(qz) OVER o AS lz FROM rim WINDOW k AS (PARTITION BY normal, fx, fy, fz, w), o AS (PARTITION BY normal, fx, fy, fz, w ORDER BY x, y, z, axis)),
    line AS (SELECT *, qx AS ax, qy AS ay, qz AS az, CASE WHEN n = 2 THEN lx ELSE mx END AS bx, CASE WHEN n = 2 THEN ly ELSE my END AS by_, CASE WHEN n = 2 THEN lz ELSE mz END AS bz FROM rated WHERE n > 2 OR (n = 2 AND turn = 1)),
    fragment AS MATERIALIZED (SELECT * FROM line WHERE ax <> bx OR ay <> by_ OR az <> bz)"""


GVD3 = ", ".join([tree3(), VERTICES3, EDGES3, nearest3("vert"), _crossed3(), _faces3()])


def _surface3() -> str:
    sides = " UNION ALL ".join(f"SELECT {s}_level AS level, {s}_cx AS cx, {s}_cy AS cy, {s}_cz AS cz, la, lb, ax, ay, az, bx, by_, bz, x AS rx, y AS ry, z AS rz FROM fragment" for s in "pq")
    u, v = [f"(b{'y_' if a == 'y' else a} - a{a})" for a in "xyz"], [f"(t{a} - a{a})" for a in "xyz"]
    n = [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    out = " + ".join(f"{x} * (r{a} - a{a})" for x, a in zip(n, "xyz", strict=True))
    return f"""side AS ({sides}), tip AS (SELECT DISTINCT level, cx, cy, cz, ax AS x, ay AS y, az AS z FROM side UNION SELECT level, cx, cy, cz, bx, by_, bz FROM side),
    middle AS (SELECT level, cx, cy, cz, avg(x) AS tx, avg(y) AS ty, avg(z) AS tz FROM tip GROUP BY level, cx, cy, cz),
    made AS (SELECT s.*, tx, ty, tz, {out} > 1e-3 AS out FROM side s JOIN middle USING (level, cx, cy, cz)),
    surface AS (SELECT la AS label, lb AS other, * EXCLUDE (la, lb), out AS swap FROM made UNION ALL SELECT lb, la, * EXCLUDE (la, lb), NOT out FROM made)"""


SURFACE3 = _surface3()
