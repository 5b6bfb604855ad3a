"""Segments in the plane as arrays: the cells that many segments meet at once.

Rows are Arrow batches with whole-numbered ends a and b; the cells are those of
``geom.segment_box_overlap``, found column by column in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lattica.functions.solids import numbers, spread

ENDS = ["ax", "ay", "bx", "by"]
#: Coordinates up to which the products stay within 64 bits.
WIDEST = 1 << 29


def ends(rows: pa.RecordBatch) -> list[np.ndarray]:
    return numbers(rows, ENDS)


def cells_of(segments: list[np.ndarray], side: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cx, cy): each closed cell of a grid of ``count`` by ``count`` that a segment meets; a row's cells come together."""
    if any(len(c) and max(-int(c.min()), int(c.max())) > WIDEST for c in segments):
        raise ValueError(f"coordinates of segments may be {WIDEST} at most")
    ax, ay, bx, by = segments
    back = bx < ax
    ax, ay, bx, by = (np.where(back, q, p) for p, q in ((ax, bx), (ay, by), (bx, ax), (by, ay)))
    first, last = np.maximum(-(-ax // side) - 1, 0), np.minimum(bx // side, count - 1)
    for row, turn in spread(np.maximum(last - first + 1, 0)):
        cx = first[row] + turn
        # where the segment enters and leaves the column; y is (ay * dx + dy * (x - ax)) / dx
        dx, dy = bx[row] - ax[row], by[row] - ay[row]
        steep = dx == 0
        d = np.where(steep, 1, dx)
        low, high = (ay[row] * d + dy * (x - ax[row]) for x in (np.maximum(cx * side, ax[row]), np.minimum((cx + 1) * side, bx[row])))
        high = np.where(steep, by[row], high)
        low, high = np.minimum(low, high), np.maximum(low, high)
        d = d * side
        bottom, top = np.maximum(-(-low // d) - 1, 0), np.minimum(high // d, count - 1)
        tall = np.maximum(top - bottom + 1, 0)
        at = np.repeat(np.arange(len(row)), tall)
        if len(at):
            until = np.cumsum(tall)
            yield row[at], cx[at], bottom[at] + np.arange(len(at)) - (until[at] - tall[at])


def cells_met(segments: list[np.ndarray], side: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell): the cells of ``cells_of``, numbered in the order of cx, cy."""
    for row, cx, cy in cells_of(segments, side, count):
        yield row, cx * count + cy
