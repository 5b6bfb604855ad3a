"""Morton codes, octants, directions and lattice positions as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.vec import Point

# Fixed values of the octree's integer space.
MAX_LEVEL = 24
ROOT_WIDTH = 1 << 25


@dataclass(frozen=True)
class Resolution:
    """A lattice of ``width`` (a power of two) in ``dim`` dimensions."""

    width: int
    dim: int = 2

    def __post_init__(self):
        if self.width <= 0 or self.width & (self.width - 1):
            raise ValueError("width has to be a positive power of two")
        if self.dim * self.bits > 62:
            raise ValueError("a Morton code has to fit 62 bits")

    @property
    def bits(self) -> int:
        return self.width.bit_length() - 1

    @property
    def code_bits(self) -> int:
        return self.dim * self.bits

    @property
    def volume(self) -> int:
        return self.width**self.dim


def encode(p: Point, r: Resolution) -> Column:
    """Interleaved bits: bit i of axis j goes to position i * dim + j."""
    out = F.lit(0).cast("long")
    for i in range(r.bits):
        for j, c in enumerate(p):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), i * r.dim + j))
    return out


def decode(z: Column, r: Resolution) -> Point:
    out = []
    for j in range(r.dim):
        c = F.lit(0).cast("long")
        for i in range(r.bits):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(z, i * r.dim + j).bitwiseAND(F.lit(1).cast("long")), i))
        out.append(c)
    return tuple(out)


def lcp_length(a: Column, b: Column, r: Resolution) -> Column:
    """Leading bits that two codes share; all of them when they are equal."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, r.code_bits).otherwise(r.code_bits - F.length(F.bin(x))).cast("int")


def lcp_value(z: Column, length: Column, r: Resolution) -> Column:
    """The top ``length`` bits, right-aligned."""
    return F.call_function("shiftright", z, (r.code_bits - length).cast("int"))


def prefix(z: Column, level: Column, r: Resolution) -> Column:
    """The octree cell of a code at a level."""
    return F.call_function("shiftright", z, (r.dim * (r.bits - level)).cast("int"))


def octants(z: Column, levels: Column, r: Resolution) -> Column:
    """Octant digits of the first ``levels`` levels, from the root."""
    digit = lambda k: prefix(z, k, r).bitwiseAND(F.lit((1 << r.dim) - 1).cast("long")).cast("int")
    return F.when(levels > 0, F.transform(F.sequence(F.lit(1), levels), digit)).otherwise(F.array().cast("array<int>"))


def level_width(level: Column) -> Column:
    return F.call_function("shiftright", F.lit(ROOT_WIDTH), level.cast("int"))


def corner(base: Point, corner_index: Column, width: Column) -> Point:
    """Corner of a cell: bit j of the index moves along axis j."""
    return tuple(c + width * F.shiftright(corner_index, j).bitwiseAND(F.lit(1)) for j, c in enumerate(base))


def offset(base: Point, pos: Column, neg: Column, width: Column) -> Point:
    bit = lambda m, j: F.shiftright(m, j).bitwiseAND(F.lit(1))
    return tuple(c + width * (bit(pos, j) - bit(neg, j)) for j, c in enumerate(base))


def positive_neighbour_corner(corner_index: Column, axis: Column) -> Column:
    """The corner one step up an axis, -1 if already there."""
    step = F.call_function("shiftleft", F.lit(1), axis)
    return F.when(corner_index.bitwiseAND(step) != 0, -1).otherwise(corner_index + step)


def cardinal_index(axis: Column, positive: Column) -> Column:
    return axis * 2 + positive.cast("int")


def edge_index(axis: Column, first: Column, second: Column) -> Column:
    return axis * 4 + first.cast("int") * 2 + second.cast("int")


def direction_of_axis(axis: Column, positive: Column) -> tuple[Column, Column]:
    """(pos, neg) masks of one step along an axis."""
    bit = F.call_function("shiftleft", F.lit(1), axis)
    return F.when(positive, bit).otherwise(0), F.when(positive, 0).otherwise(bit)


def direction_of_corner(corner_index: Column, dim: int) -> tuple[Column, Column]:
    """Up along the axes whose bit is set, down along the others."""
    return corner_index, corner_index.bitwiseXOR(F.lit((1 << dim) - 1))


def direction_of_sublattice(index: Column, dim: int) -> tuple[Column, Column]:
    """The direction that ``sublattice_index`` numbers."""
    digit = lambda j: F.pmod(F.floor(index / 3**j), F.lit(3))
    mask = lambda d: sum((F.when(digit(j) == d, 1 << j).otherwise(0) for j in range(dim)), F.lit(0))
    return mask(2), mask(0)


def level_of_width(width: Column, root: int) -> Column:
    """The level of cells of that width, a power of two, under a root of width ``root``."""
    return (F.lit(root.bit_length()) - F.length(F.bin(width.cast("long")))).cast("int")


def cell_centre(base: Point, width: Column) -> Point:
    return tuple(c + F.floor(width / 2) for c in base)


def reverse(pos: Column, neg: Column) -> tuple[Column, Column]:
    return neg, pos


def add_directions(pos: Column, neg: Column, pos2: Column, neg2: Column) -> tuple[Column, Column]:
    """Sum of two directions: opposite steps cancel."""
    up, down = pos.bitwiseOR(pos2), neg.bitwiseOR(neg2)
    both = up.bitwiseAND(down)
    return up.bitwiseAND(F.bitwise_not(both)), down.bitwiseAND(F.bitwise_not(both))


def sublattice_index(pos: Column, neg: Column, dim: int) -> Column:
    """Base-3 number of a direction: digit 1 + up - down for each axis."""
    bit = lambda m, j: F.shiftright(m, j).bitwiseAND(F.lit(1))
    out = F.lit(0)
    for j in range(dim):
        out = out + (1 + bit(pos, j) - bit(neg, j)) * 3**j
    return out
