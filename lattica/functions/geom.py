"""Geometric predicates and kernels as column expressions.

Integer inputs stay integer where the result is decided by a sign, so those predicates
are exact; boxes are closed unless said otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import vec
from lattica.functions.vec import Point


def all_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def in_open(p: Point, low: Point, high: Point, eps=0) -> Column:
    return all_of(*[(c > a - eps) & (c < b + eps) for c, a, b in zip(p, low, high, strict=True)])


def in_half_open(p: Point, low: Point, high: Point, eps=0) -> Column:
    return all_of(*[(c >= a - eps) & (c < b + eps) for c, a, b in zip(p, low, high, strict=True)])


def in_closed(p: Point, low: Point, high: Point, eps=0) -> Column:
    return all_of(*[(c >= a - eps) & (c <= b + eps) for c, a, b in zip(p, low, high, strict=True)])


def intervals_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """[a, b] and [c, d] share a point."""
    return (a <= d) & (c <= b)


def boxes_touch(low: Point, high: Point, low2: Point, high2: Point) -> Column:
    return all_of(*[intervals_overlap(a, b, c, d) for a, b, c, d in zip(low, high, low2, high2, strict=True)])


def within(a: Column, b: Column, eps) -> Column:
    return F.abs(a - b) < eps


def outcode(p: Point, low=-1, high=1) -> Column:
    """Four bits: left 1, right 2, below 4, above 8."""
    x, y = p
    flag = lambda c, v: F.when(c, v).otherwise(0)
    return flag(x < low, 1) + flag(x > high, 2) + flag(y < low, 4) + flag(y > high, 8)


def orientation(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area of a triangle."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def segment_box_overlap(a: Point, b: Point, low: Point, high: Point) -> Column:
    """Separating axes of a segment and a square: the two axes and the segment's normal."""
    boxed = boxes_touch(vec.least(a, b), vec.greatest(a, b), low, high)
    sides = [orientation(a, b, (x, y)) for x in (low[0], high[0]) for y in (low[1], high[1])]
    return boxed & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def triangle_box_overlap(t: tuple[Point, Point, Point], low: Point, high: Point, size=None) -> Column:
    """Separating axes of a triangle and a box: three axes, the plane, nine edge crosses.

    Coordinates are doubled around the box's centre, so integers stay exact. An edge's two
    ends have one projection on the axes across it, so each of these looks at two points;
    that also keeps the expression small enough to be compiled, as does ``size``, a cube's
    known side.
    """
    if size is not None:
        high = tuple(c + size for c in low)
    centre, half = (vec.add(low, high), vec.sub(high, low)) if size is None else (tuple(c * 2 + size for c in low), (F.lit(size),) * 3)
    moved = lambda v, i: v[i] * 2 - centre[i]
    tests = [(F.least(*[v[i] for v in t]) <= high[i]) & (F.greatest(*[v[i] for v in t]) >= low[i]) for i in range(3)]
    normal = vec.cross(vec.sub(t[1], t[0]), vec.sub(t[2], t[0]))
    reach = vec.component_sum(tuple(F.abs(n) * h for n, h in zip(normal, half, strict=True)))
    tests.append(F.abs(vec.component_sum(tuple(n * moved(t[0], i) for i, n in enumerate(normal)))) <= reach)
    for k in range(3):
        p, q, r = t[k], t[(k + 1) % 3], t[(k + 2) % 3]
        for i in range(3):
            j, m = (i + 1) % 3, (i + 2) % 3
            ej, em = q[j] - p[j], q[m] - p[m]
            one, two = (ej * moved(v, m) - em * moved(v, j) for v in (p, r))
            reach = F.abs(ej) * half[m] + F.abs(em) * half[j]
            tests.append((F.least(one, two) <= reach) & (F.greatest(one, two) >= -reach))
    return all_of(*tests)


def closest_on_segment(p: Point, a: Point, b: Point) -> Point:
    """The point of a segment nearest to p; a degenerate segment is its first end."""
    d = vec.sub(b, a)
    n = F.nullif(vec.length2(d).cast("double"), F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), vec.dot(vec.sub(p, a), d) / n)), F.lit(0.0))
    return tuple(x + t * y for x, y in zip(a, d, strict=True))


def point_segment_distance2(p: Point, a: Point, b: Point) -> Column:
    return vec.length2(vec.sub(p, closest_on_segment(p, a, b)))


def triangle_normal(a: Point, b: Point, c: Point) -> Point:
    """The raw cross product of two edges, not normalised."""
    return vec.cross(vec.sub(b, a), vec.sub(c, a))


def point_triangle_distance2(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Squared distance to a triangle; a degenerate one counts as its edges."""
    n = triangle_normal(a, b, c)
    n2 = vec.length2(n).cast("double")
    side = lambda u, v: vec.dot(vec.cross(vec.sub(v, u), vec.sub(p, u)), n)
    inside = (n2 > 0) & (side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0)
    height = vec.dot(vec.sub(p, a), n).cast("double")
    edges = F.least(*[point_segment_distance2(p, u, v) for u, v in ((a, b), (b, c), (c, a))])
    return F.when(inside, height * height / F.nullif(n2, F.lit(0.0))).otherwise(edges)


def closest_on_triangle(rows: DataFrame, p: Point, a: Point, b: Point, c: Point, to: str) -> DataFrame:
    """Adds ``to``x, ``to``y, ``to``z: the point of a triangle nearest to p.

    Outside the triangle's prism it is a point of the edges, the first of equally near ones.
    The steps are columns of their own, as one expression would repeat them many times.
    """
    n = triangle_normal(a, b, c)
    n2 = vec.length2(n).cast("double")
    side = lambda u, v: vec.dot(vec.cross(vec.sub(v, u), vec.sub(p, u)), n)
    sides = ((a, b), (b, c), (c, a))
    inside = (n2 > 0) & (side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0)
    kept = [name for name in rows.columns if name not in {to + axis for axis in "xyz"}]
    feet = [F.array(*[x.cast("double") for x in closest_on_segment(p, u, v)]).alias(f"_f{i}") for i, (u, v) in enumerate(sides)]
    step = rows.select(*kept, inside.alias("_in"), (vec.dot(vec.sub(p, a), n).cast("double") / F.nullif(n2, F.lit(0.0))).alias("_lift"), F.array(*[x.cast("double") for x in n]).alias("_n"), *feet)
    far = [sum((q * q for q in (x - F.get(f"_f{i}", k) for k, x in enumerate(p))), F.lit(0.0)).alias(f"_d{i}") for i in range(3)]
    step = step.select("*", *far)
    foot = F.when((F.col("_d0") <= F.col("_d1")) & (F.col("_d0") <= F.col("_d2")), F.col("_f0")).when(F.col("_d1") <= F.col("_d2"), F.col("_f1")).otherwise(F.col("_f2"))
    made = [F.when(F.col("_in"), x - F.col("_lift") * F.get("_n", k)).otherwise(F.get(foot, k)).alias(to + axis) for k, (x, axis) in enumerate(zip(p, "xyz", strict=True))]
    return step.select(*kept, *made)


def segments_cross(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Proper crossing: each segment's ends lie strictly on both sides of the other."""
    sign = lambda x: F.signum(x).cast("int")
    return (sign(orientation(a, b, c)) * sign(orientation(a, b, d)) < 0) & (sign(orientation(c, d, a)) * sign(orientation(c, d, b)) < 0)


def line_intersection(a: Point, b: Point, c: Point, d: Point) -> tuple[Column, Column]:
    """Where two lines meet; null if they are parallel."""
    u, v = vec.sub(b, a), vec.sub(d, c)
    det = F.nullif((u[0] * v[1] - u[1] * v[0]).cast("double"), F.lit(0.0))
    w = vec.sub(c, a)
    t = (w[0] * v[1] - w[1] * v[0]) / det
    return a[0] + t * u[0], a[1] + t * u[1]


def collinear_overlap(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Two parallel segments on one line with overlapping extents."""
    line = (orientation(a, b, c) == 0) & (orientation(a, b, d) == 0)
    return line & boxes_touch(vec.least(a, b), vec.greatest(a, b), vec.least(c, d), vec.greatest(c, d))


def x_at(a: Point, b: Point, y: Column) -> Column:
    """x of a line at y; null if the line is level."""
    return a[0] + (b[0] - a[0]) * (y - a[1]) / F.nullif((b[1] - a[1]).cast("double"), F.lit(0.0))


def y_at(a: Point, b: Point, x: Column) -> Column:
    return x_at((a[1], a[0]), (b[1], b[0]), x)


def segment_distance2(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Squared distance of two segments in the plane."""
    ends = F.least(point_segment_distance2(a, c, d), point_segment_distance2(b, c, d), point_segment_distance2(c, a, b), point_segment_distance2(d, a, b))
    return F.when(segments_cross(a, b, c, d), F.lit(0.0)).otherwise(ends)


def midpoint(a: Point, b: Point) -> Point:
    return tuple((x + y) / 2 for x, y in zip(a, b, strict=True))


def clip_start(a: Point, b: Point, low: Point, high: Point) -> Point:
    """First point of a segment inside a box; null if it misses the box."""
    t0, t1 = F.lit(0.0), F.lit(1.0)
    ok = F.lit(True)
    for p, q, lo, hi in zip(a, b, low, high, strict=True):
        d = F.nullif((q - p).cast("double"), F.lit(0.0))
        s, e = (lo - p) / d, (hi - p) / d
        t0 = F.greatest(t0, F.coalesce(F.least(s, e), t0))
        t1 = F.least(t1, F.coalesce(F.greatest(s, e), t1))
        ok = ok & (d.isNotNull() | ((p >= lo) & (p <= hi)))
    return tuple(F.when(ok & (t0 <= t1), p + t0 * (q - p)) for p, q in zip(a, b, strict=True))


def bisector_on_edge(a: Point, length: Column, axis: Column, pa: Point, pb: Point) -> Column:
    """Offset along an axis edge from a where pa and pb are equally far, clamped to the edge; null if they never are."""
    d = vec.sub(pb, pa)
    along = F.nullif((2 * vec.component(d, axis)).cast("double"), F.lit(0.0))
    gap = vec.length2(vec.sub(a, pb)) - vec.length2(vec.sub(a, pa))
    return F.when(along.isNotNull(), F.greatest(F.lit(0.0), F.least(length.cast("double"), gap / along)))  # least() passes over nulls


def interpolate(v0: Point, v1: Point, d0: Column, d1: Column, f: Column) -> Point:
    """Point between v0 and v1 where the value reaches f."""
    t = (f - d0) / F.nullif((d1 - d0).cast("double"), F.lit(0.0))
    return tuple(p + t * (q - p) for p, q in zip(v0, v1, strict=True))


def angle_bin(theta: Column, k: int) -> Column:
    return F.pmod(F.floor(theta / (2 * math.pi) * k), F.lit(k)).cast("int")


def angle_bin_2d(x: Column, y: Column, k: int) -> Column:
    """acos(x) of a unit vector, with half a turn added below the axis."""
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return angle_bin(F.when(y < 0, theta + math.pi).otherwise(theta), k)


def angle_bin_3d(x: Column, y: Column, z: Column, k: int) -> Column:
    """Bins of longitude and latitude, the square root of k of each; both angles are binned over a full turn."""
    side = math.isqrt(k)
    return (angle_bin(F.atan2(z, F.sqrt(x * x + y * y)), side) * side + angle_bin(F.atan2(y, x), side)).cast("int")


def is_square(low: Point, high: Point) -> Column:
    """All extents of a box are equal."""
    sizes = vec.sub(high, low)
    return all_of(*[s == sizes[0] for s in sizes[1:]])


def segment_axis(a: Point, b: Point) -> tuple[Point, Column, Column]:
    """(unit normal, least and largest projection) of a segment, for separating-axis tests; null if it has no length."""
    n = vec.normalize((-(b[1] - a[1]), b[0] - a[0]))
    p, q = vec.dot(n, a), vec.dot(n, b)
    return n, F.least(p, q), F.greatest(p, q)


def v_segments(a: Point, b: Point, c: Point, d: Point) -> tuple[Point, Point, Point, Point]:
    """Two segments as the arms of a V: (tip, end) of the first arm, (tip, end) of the second.

    The tip of the first arm is the end that lies nearest to the other segment, its twin
    there the tip of the second. The second arm goes on to the far end that points the way
    of the first, else to the other one. Ties take the first of a, b, c, d.
    """
    tries = [(a, b, c, d), (b, a, c, d), (c, d, a, b), (d, c, a, b)]
    rated = [(vec.length2(vec.sub(tip, closest_on_segment(tip, u, v))).cast("double"), tip, end, closest_on_segment(tip, u, v), u, v) for tip, end, u, v in tries]
    made = None
    for distance, tip, end, near, u, v in reversed(rated):
        arm = vec.sub(end, tip)
        onto = vec.dot(arm, vec.sub(v, near)) > 0
        row = F.struct(*[x.cast("double").alias(n + axis) for n, p in (("a", tip), ("b", end), ("c", near), ("d", tuple(F.when(onto, y).otherwise(x) for x, y in zip(u, v, strict=True)))) for axis, x in zip("xy", p, strict=True)])
        least = F.least(*[r[0] for r in rated])
        made = row if made is None else F.when(distance == least, row).otherwise(made)
    return tuple((made[f"{n}x"], made[f"{n}y"]) for n in "abcd")


def ray_hit(origin: Point, ray: Point, a: Point, b: Point, c: Point) -> Column:
    """Parameter where a ray's line meets a triangle, null if it misses."""
    n = triangle_normal(a, b, c)
    t = vec.dot(n, vec.sub(a, origin)) / F.nullif(vec.dot(n, ray).cast("double"), F.lit(0.0))
    hit = tuple(o + t * r for o, r in zip(origin, ray, strict=True))
    side = lambda u, v: vec.dot(vec.cross(vec.sub(v, u), vec.sub(hit, u)), n)
    return F.when((side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0), t)
