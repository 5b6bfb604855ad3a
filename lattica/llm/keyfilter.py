"""Bit filters of 64-bit keys: of fixed size, so that they can be broadcast at any scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import U64, in_batches, mix

#: Bytes of a filter that travel as one row.
PIECE = 1 << 16
#: Bits for each key; one key in so many passes that isn't there.
SPARE = 16


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(np.asarray(keys, np.int64).view(U64), 21) % U64(1 << bits)).astype(np.int64)


def build(rows: DataFrame, key: str, bits: int) -> bytes:
    """The filter of all keys of a column, 2**bits bits in all. Sixteen tasks send a filter each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            held[places(batch.column(0).to_numpy(), bits)] = True
        packed = np.packbits(held, bitorder="little")
        for at in range(0, len(packed), PIECE):
            part = packed[at : at + PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], ["at", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in in_batches(rows.select(F.col(key).alias("key")).coalesce(16), run, "at long, bits binary").toLocalIterator():
        got = np.frombuffer(zstandard.decompress(bytes(row.bits)), np.uint8)
        out[row["at"] : row["at"] + len(got)] |= got
    return out.tobytes()


def mask(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; held: its bytes."""
    at = places(keys, len(held).bit_length() + 2)
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def bits_for(keys: int, most: int = 27) -> int | None:
    """The size of a filter of so many keys, or None if it would be larger than 2**most bits."""
    bits = max(16, (keys * SPARE - 1).bit_length())
    return bits if bits <= most else None
