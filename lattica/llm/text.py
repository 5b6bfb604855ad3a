"""Vectorised text helpers: whole Arrow batches of UTF-8 text become arrays of word hashes.

Every function reads the bytes of a batch as one buffer, so no Python object is made
for a word. Memory follows ``CHUNK_BYTES``, or the longest single text if that is longer.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 512 << 10
BATCH_BYTES = 1 << 20
U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}

#: Kept bytes of a lane that holds 0 to 8 bytes of a word.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Words up to this many bytes are hashed lane by lane, all at once.
SHORT = 64


def byte_tables(lower: bool, words: str) -> tuple[np.ndarray, np.ndarray]:
    """(value of each byte, its class); a word is a run of bytes of one class, class 0 separates.

    words: 'space' cuts at ASCII white space; 'alnum' keeps digits, letters and all beyond
    ASCII; 'marks' also takes runs of other visible characters as words; 'runs' takes
    runs of letters, of digits and of everything else but white space; 'all' takes white space too.
    """
    key = f"{lower}{words}"
    if key not in _TABLES:
        codes = np.arange(256)
        kept = np.where(lower & (codes >= 65) & (codes <= 90), codes + 32, codes)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        letter = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122)) | (codes >= 128)
        if words == "space":
            kind = ~space
        elif words == "alnum":
            kind = letter
        elif words == "marks":
            kind = np.where(letter, 1, np.where((codes > 32) & (codes < 127), 2, 0))
        else:
            kind = np.where((codes >= 48) & (codes <= 57), 2, np.where(letter, 1, np.where(space, 4 if words == "all" else 0, 3)))
        _TABLES[key] = kept.astype(np.uint8), kind.astype(np.uint8)
    return _TABLES[key]


def new_key() -> bytes:
    """A secret of 128 bits for the hashes of one run; tasks that are run again get the same."""
    return secrets.token_bytes(16)


class Words:
    """Words of consecutive documents in one byte buffer.

    ``start`` and ``end`` are byte positions, ``hash`` identifies the word, and the
    words of document i are ``ptr[i]:ptr[i + 1]``. A word is hashed eight bytes at a time,
    each step a finaliser over the last, so that no word of up to eight bytes shares its
    hash with another of its length; words above SHORT bytes are hashed one by one. Without
    a ``key`` the hash is the same in every run, good for features, but words that collide
    can be worked out. Where a hash stands for the word, a secret ``key`` of the run
    (``new_key``) goes into every step, and longer words collide by chance alone (64
    bits). ``folded`` is the text as it is hashed, with zeros after it. About ten bytes are
    held for each byte of text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, words: str = "space", key: bytes | None = None):
        value, kinds = byte_tables(lower, words)
        n = len(data)
        kind = np.take(kinds, data, mode="clip")
        edge = np.empty(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        edge[0] = edge[n] = True
        edge[offsets] = True
        bounds = np.flatnonzero(edge)
        inside = kind[bounds[:-1]] > 0
        self.start, self.end = bounds[:-1][inside], bounds[1:][inside]
        self._cut(data, offsets, kind[self.start])
        self.ptr = np.searchsorted(self.start, offsets)
        self.folded = np.zeros(n + 16, np.uint8)
        self.folded[:n] = np.take(value, data, mode="clip")
        self.size = self.end - self.start
        one, two = np.frombuffer(key, U64) if key else (U64(0), U64(0))
        self.hash = mix(self.lane(0) ^ (self.size.astype(U64) * _MUL) ^ one)
        if key:
            self.hash = mix(self.hash + two, 8)
        longer = np.flatnonzero(self.size > 8)
        for k in range(1, SHORT // 8):
            if not len(longer):
                break
            lane = self.lane(k, longer)
            self.hash[longer] = mix((self.hash[longer] ^ two) * _MUL + (mix(lane ^ one, 9) if key else lane), k)
            longer = longer[self.size[longer] > 8 * (k + 1)]
        for i in longer.tolist():  # above SHORT bytes
            word = self.folded[self.start[i] : self.end[i]].data
            if key:
                self.hash[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key).digest(), "little")
            else:
                self.hash[i] = xxhash.xxh3_64_intdigest(word, int(self.hash[i]))

    def _cut(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> None:
        """Place for another way to cut the runs, given the class of each."""

    def lane(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of words as one number, 0 beyond a word's end."""
        every = np.lib.stride_tricks.as_strided(self.folded[:8].view(U64), (len(self.folded) - 8,), (1,))
        held = np.clip(self.size[at] - 8 * k, 0, 8)
        return every[np.minimum(self.start[at] + 8 * k, len(every) - 1)] & _LANE[held]

    def opening(self, doc: int, width: int) -> bytes:
        """The first ``width`` words of a document as they are hashed, with blanks between."""
        low, high = self.ptr[doc], min(self.ptr[doc] + width, self.ptr[doc + 1])
        return b" ".join(self.folded[a:b].tobytes() for a, b in zip(self.start[low:high], self.end[low:high], strict=True))

    def head(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word, 8 at most."""
        held = np.minimum(self.size, size)
        return mix((self.lane(0) & _LANE[held]) ^ (held.astype(U64) * _MUL))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ptr): windows of ``width`` words; fewer words form one shingle, none form none."""
        counts = np.diff(self.ptr)
        n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        ptr = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(ptr[-1], U64)
        doc = np.repeat(np.arange(len(n)), n)
        at = self.ptr[:-1][doc] + (np.arange(ptr[-1]) - ptr[:-1][doc])
        long = counts[doc] >= width
        spots = at[long]
        value = np.zeros(len(spots), U64)
        for k in range(width):
            value = mix(value * _MUL + self.hash[spots + k], k)
        out[long] = value
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            value = np.full(1, counts[i], U64)
            for h in self.hash[self.ptr[i] : self.ptr[i + 1]]:
                value = mix(value * _MUL + h, 99)
            out[ptr[i]] = value[0]
        return out, ptr


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow array without nulls in the buffer's length."""
    if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes of text (one row at least): (rows, bytes, offsets)."""
    at = batch.schema.get_field_index(column)
    data, offsets = buffers(batch.column(at))
    row, n = 0, batch.num_rows
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = min(max(last, row + 1), n)
        yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def bound_batches(docs: DataFrame) -> None:
    """Have the session pass texts to Python in Arrow batches of about BATCH_BYTES, whatever their rows hold."""
    conf = docs.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name, None) or "")
    if not now or int(now[1]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a worker process keeps between the tasks of one operator."""
    return _KEPT.setdefault(owner, {})


def _give_back() -> None:
    """Return freed memory to the system, as workers of other operators run beside this one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, owner: str = "") -> DataFrame:
    """``mapInArrow`` whose workers drop what other operators kept, and give memory back after each task.

    Worker processes are used again by later stages, so without this a job's stages add up.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in _KEPT if k != owner]:
            del _KEPT[other]
        try:
            yield from run(batches)
        finally:
            _give_back()

    return rows.mapInArrow(task, schema)


def free_name(name: str, columns: list[str]) -> str:
    """The name, or a longer one if a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: Column | str) -> Column:
    """The text as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def filter_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[list[str]], np.ndarray]], owner: str = "") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text passes. judge: makes, once a task, a function from texts (null as empty) to a mask."""
    bound_batches(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = judge()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, texts in text_runs(batch.column(at)):
                keep[first : first + len(texts)] = passes(texts)
            yield batch.filter(pa.array(keep))

    return in_batches(docs, run, docs.schema, owner)


def text_runs(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about ``limit`` characters; null is empty."""
    run: list[str] = []
    size = first = 0
    for row, scalar in enumerate(texts):
        text = scalar.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= limit:
            yield first, run
            run, size, first = [], 0, row + 1
    if run:
        yield first, run


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts laid end to end."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; the split of labelled rows."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus
