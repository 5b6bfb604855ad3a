"""Pairs of whole numbers packed for a shuffle: one row for each first number, with the distances between its sorted second ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are sorted at once.
TOGETHER = 1 << 22
PACKED = ["one", "known", "first", "width", "steps"]
SCHEMA = "one long, known boolean, first long, width int, steps binary"


def _sorted(one: np.ndarray, two: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, each known if it ever is."""
    if not len(one):
        return one, two, known
    low, least = int(one.min()), int(two.min())
    wide = int(two.max()) - least + 1
    if (int(one.max()) - low + 1) * wide < 1 << 62:
        code = ((one - low) * wide + (two - least)) * 2 + ~known
        code.sort()
        pair = code >> 1
        keep = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        one, two = np.divmod(pair[keep], wide)
        return one + low, two + least, (code[keep] & 1) == 0
    order = np.lexsort((~known, two, one))
    one, two, known = one[order], two[order], known[order]
    keep = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    return one[keep], two[keep], known[keep]


def _starts(one: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))


def _packed(one: np.ndarray, two: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
    one, two, _ = _sorted(one, two, np.zeros(len(one), bool))
    if not len(one):
        return
    start = _starts(one)
    size = np.diff(np.append(start, len(one)))
    step = np.diff(two, prepend=two[:1]).view(np.uint64)  # beyond 63 bits they wrap, and wrap back
    step[start] = 0
    most = np.maximum.reduceat(step, start)
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        if not len(rows):
            continue
        data = step[np.repeat(width == w, size)].astype(f"<u{w}")
        offsets = np.concatenate([[0], np.cumsum(size[rows] * w)]).astype(np.int32)
        steps = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.array(one[start[rows]]), pa.array(np.full(len(rows), known)), pa.array(two[start[rows]]), pa.array(np.full(len(rows), w, np.int32)), steps], PACKED)


def in_turn(one: np.ndarray, turns: int, turn: int) -> np.ndarray:
    """Which first numbers belong to one of several turns, dealt by a hash."""
    return (one.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(turns) == turn


def pack(known: bool, turns: int = 1, turn: int = 0):
    """For ``mapInArrow``: two columns of whole numbers to rows of SCHEMA; pairs of a task are made distinct as far as they come together.

    Only pairs whose first number belongs to the turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        flush = lambda: _packed(*[np.concatenate([h[i] for h in held]) for i in (0, 1)], known)
        for batch in batches:
            both = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in (0, 1)]
            if turns > 1:
                keep = in_turn(both[0], turns, turn)
                both = [c[keep] for c in both]
            held.append(both)
            n += len(both[0])
            if n >= TOGETHER:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return run


def _numbers(first: pa.Array, width: pa.Array, steps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, rows' sizes) of packed numbers."""
    first, width = (c.to_numpy(zero_copy_only=False) for c in (first, width))
    offsets = np.frombuffer(steps.buffers()[1], np.int32)[steps.offset : steps.offset + len(steps) + 1].astype(np.int64)
    data = np.frombuffer(steps.buffers()[2], np.uint8)
    size = np.diff(offsets) // width
    until = np.cumsum(size)
    row = np.repeat(np.arange(len(size)), size)
    at = offsets[row] + (np.arange(len(row)) - (until - size)[row]) * width[row]
    step = np.zeros(len(row), np.uint64)
    for k in range(int(width.max())):
        wide = np.flatnonzero(width[row] > k)
        step[wide] |= data[at[wide] + k].astype(np.uint64) << np.uint64(8 * k)
    total = np.cumsum(step.view(np.int64))
    return row, total - total[until - size][row] + first[row], size


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, two, _ = _numbers(*[batch.column(i) for i in (2, 3, 4)])
    return batch.column(0).to_numpy()[row], two, batch.column(1).to_numpy(zero_copy_only=False)[row].astype(bool)


def paths(turns: int = 1, turn: int = 0):
    """For ``mapInArrow``: rows of two packed lists (first, width, steps of each) to the pairs of one's and the other's numbers, as rows of SCHEMA; of the turn's first numbers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        flush = lambda: _packed(*[np.concatenate([h[i] for h in held]) for i in (0, 1)], False)
        for batch in batches:
            if not batch.num_rows:
                continue
            (of, one, many), (_, two, more) = (_numbers(*batch.columns[k : k + 3]) for k in (0, 3))
            if turns > 1:
                keep = in_turn(one, turns, turn)
                one, many = one[keep], np.bincount(of[keep], minlength=len(many))
            until, begin_one, begin_two = np.cumsum(many * more), np.cumsum(many) - many, np.cumsum(more) - more
            total = int(until[-1])
            for begin in range(0, total, TOGETHER):
                at = np.arange(begin, min(begin + TOGETHER, total))
                row = np.searchsorted(until, at, "right")
                place = at - (until[row] - (many * more)[row])
                far, near = np.divmod(place, more[row])
                held.append((one[begin_one[row] + far], two[begin_two[row] + near]))
                n += len(at)
                if n >= TOGETHER:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def fresh(names: list[str], sizes: bool = False):
    """For ``mapInArrow``: of rows of SCHEMA, partitioned and sorted by ``one``, the pairs that none of the known rows has, each once.

    sizes: first numbers with the number of those pairs instead."""

    def told(one: np.ndarray, two: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        if sizes:
            if len(one):
                n = np.add.reduceat((~known).astype(np.int64), _starts(one))
                yield pa.RecordBatch.from_arrays([pa.array(one[_starts(one)][n > 0]), pa.array(n[n > 0])], names)
            return
        for begin in range(0, len(one), 1 << 16):
            part = slice(begin, begin + (1 << 16))
            keep = ~known[part]
            yield pa.RecordBatch.from_arrays([pa.array(one[part][keep]), pa.array(two[part][keep])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, TOGETHER
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_unpacked(batch))
            n += len(held[-1][0])
            if n >= most:
                one, two, known = _sorted(*[np.concatenate([h[i] for h in held]) for i in range(3)])
                last = _starts(one)[-1]  # its rows may go on
                yield from told(one[:last], two[:last], known[:last])
                held, n = [(one[last:], two[last:], known[last:])], len(one) - last
                most = TOGETHER + 2 * n
        if held:
            yield from told(*_sorted(*[np.concatenate([h[i] for h in held]) for i in range(3)]))

    return run
