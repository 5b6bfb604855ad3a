"""Vector algebra on points given as tuples of columns, (x, y) or (x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, ...]


def point(prefix: str, dim: int) -> Point:
    """Columns ``{prefix}x``, ``{prefix}y``[, ``{prefix}z``]."""
    return tuple(F.col(prefix + axis) for axis in "xyz"[:dim])


def broadcast_scalar(a: Column, dim: int) -> Point:
    return (a,) * dim


def lift(p: Point, a: Column) -> Point:
    """The point with one more component."""
    return (*p, a)


def add(p: Point, q: Point) -> Point:
    return tuple(a + b for a, b in zip(p, q, strict=True))


def sub(p: Point, q: Point) -> Point:
    return tuple(a - b for a, b in zip(p, q, strict=True))


def mul(p: Point, q: Point) -> Point:
    return tuple(a * b for a, b in zip(p, q, strict=True))


def scale(p: Point, a) -> Point:
    return tuple(c * a for c in p)


def int_divide(p: Point, a: int) -> Point:
    """Component-wise integer division that truncates toward zero."""
    return tuple(((c - c % a) / a).cast("long") for c in p)  # the remainder has the dividend's sign


def negate(p: Point) -> Point:
    return tuple(-c for c in p)


def least(p: Point, q: Point) -> Point:
    return tuple(F.least(a, b) for a, b in zip(p, q, strict=True))


def greatest(p: Point, q: Point) -> Point:
    return tuple(F.greatest(a, b) for a, b in zip(p, q, strict=True))


def equal(p: Point, q: Point) -> Column:
    out = p[0] == q[0]
    for a, b in zip(p[1:], q[1:], strict=True):
        out = out & (a == b)
    return out


def all_less(p: Point, a) -> Column:
    out = p[0] < a
    for c in p[1:]:
        out = out & (c < a)
    return out


def lexicographic_less(p: Point, q: Point) -> Column:
    return F.struct(*p) < F.struct(*q)


def truncate(p: Point) -> Point:
    """To integers, toward zero."""
    return tuple(c.cast("int") for c in p)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def component_sum(p: Point) -> Column:
    """The sum of the components, without absolute values."""
    return sum(p[1:], p[0])


def dot(p: Point, q: Point) -> Column:
    return component_sum(mul(p, q))


def length2(p: Point) -> Column:
    return dot(p, p)


def length(p: Point) -> Column:
    return F.sqrt(length2(p).cast("double"))


def int_length(p: Point) -> Column:
    """The length as a 32-bit float, rounded half up."""
    return round_half_up(length(p).cast("float").cast("double")).cast("long")


def normalize(p: Point) -> Point:
    """Unit vector; null for the zero vector."""
    n = F.nullif(length(p), F.lit(0.0))
    return tuple(c / n for c in p)


def cross(p: Point, q: Point) -> Point:
    return (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])


def component(p: Point, axis: Column) -> Column:
    """The component that an axis column names (0, 1, 2)."""
    return F.get(F.array(*p), axis)


def with_component(p: Point, axis: Column, value: Column) -> Point:
    return tuple(F.when(axis == i, value).otherwise(c) for i, c in enumerate(p))


def sign(c: Column) -> Column:
    return F.signum(c).cast("int")
