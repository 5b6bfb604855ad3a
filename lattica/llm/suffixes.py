"""Long repeats by a logarithmic family of sparse suffix arrays.

A repeat is a string of ``match`` bytes that starts at two places. Every possible start
has an anchor: the place of the smallest hashed 8-byte string among its next ``window``
places. That depends on bytes of the repeat alone, so equal repeats have their anchors at
equal offsets, and the suffixes at anchors, about one in ``window / 2``, are enough. A
suffix array holds them in the order of a fingerprint of their first
``match - window + 1`` bytes: suffixes that agree so far are neighbours, which is all that
a search for repeats reads of a suffix array's order.

Documents come in batches. A batch's array is scanned, as a sort-merge join, against
every level of the family; what it shares with itself or a level are heads of possible
repeats. It is then added as a level, and when the next batch comes, levels of equal size
are merged into one of twice the size, so there are logarithmically many.

Places with a shared head are then compared in full, by keyed 128-bit BLAKE2 digests: an
anchor's context reaches from its first start to the end of its last start's string, so
two equal contexts settle all their starts. Where contexts differ but heads agree, the
ends of repeats lie, and there each start's string is compared alone.

Equal texts are told apart by nothing but their number: a text that occurs twice goes
as a whole if it is long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import keyfilter
from lattica.llm.text import U64, bound_batches, chunks, in_batches, mix, utf8
from lattica.session import remove_path, scratched, write_and_reread

#: Bits of a place in the window's minimum: texts of up to 256 MB.
PLACE = 28
#: Texts that a task remembers, so as not to index equal ones twice.
SEEN = 100_000
#: Keys up to which a table of them is broadcast (16 MB).
FEW = 1 << 20
ROWS = 1 << 14
#: Rows of a partition in which single starts are compared, about.
PART_ROWS = 1 << 18


def sparse_suffixes(data: np.ndarray, offsets: np.ndarray, match: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): anchors, and the first and last start of a string of ``match`` bytes that each one stands for."""
    n = len(data)
    if n >= 1 << PLACE:
        raise ValueError(f"texts of up to {1 << PLACE} bytes are supported")
    change = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= match)
    change[offsets[long]] += 1
    change[offsets[long + 1] - match + 1] -= 1
    starts = np.flatnonzero(np.cumsum(change[:n], dtype=np.int8))
    if not len(starts):
        return starts, starts, starts
    size = -(-n // window) * window + window
    padded = np.zeros(size + 8, np.uint8)
    padded[:n] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (size,), (1,))
    low = U64((1 << PLACE) - 1)
    key = (mix(eight, 31) & ~low) | np.arange(size, dtype=U64)
    blocks = key.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(behind[starts], ahead[starts + window - 1]) & low).astype(np.int64)
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    return place[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def _digest(raw: memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, key=b"lattica repeats").digest()


class _Rows:
    """Rows gathered column by column and given out in batches."""

    def __init__(self, **kinds: pa.DataType):
        self.kinds, self.held = kinds, [[] for _ in kinds]

    def add(self, *columns: list) -> None:
        for held, column in zip(self.held, columns, strict=True):
            held.extend(column)

    def ready(self, least: int = ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.held[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(h, k) for h, k in zip(self.held, self.kinds.values(), strict=True)], list(self.kinds))
            self.held = [[] for _ in self.kinds]


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows (key, text, ...) without those whose key the task has just seen."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, key in enumerate(batch.column(0).to_pylist()):
            keep[i] = key not in seen
            if len(seen) >= SEEN:
                seen.clear()  # a text may then be met twice, as it may in two tasks
            seen.add(key)
        yield from chunks(batch.filter(pa.array(keep)), "text")


def _heads(match: int, window: int, batches_: int):
    """(batch, head) of every anchor; equal texts fall into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(batch=pa.int32(), head=pa.int64())
        for held, data, offsets in _unseen(batches):
            place, _, _ = sparse_suffixes(data, offsets, match, window)
            of = np.array([k[0] % batches_ for k in held.column(0).to_pylist()], np.int64)[np.searchsorted(offsets, place, "right") - 1]
            rows.add(of.tolist(), _head(data, place, match - window + 1).tolist())
            yield from rows.ready()
        yield from rows.ready(1)

    return run


def _head(data: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh3_64_intdigest(raw[p : p + size], 7) for p in place.tolist()], U64).view(np.int64)


def _contexts(match: int, window: int, wanted):
    """(head, full, key, lo, hi) of the anchors whose head may be shared; wanted: a filter of heads, or None for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(wanted.value, np.uint8) if wanted else None
        rows = _Rows(head=pa.int64(), full=pa.binary(), key=pa.binary(), lo=pa.int32(), hi=pa.int32())
        for held, data, offsets in _unseen(batches):
            place, first, last = sparse_suffixes(data, offsets, match, window)
            head = _head(data, place, match - window + 1)
            if filter_ is not None:
                keep = keyfilter.mask(head, filter_)
                place, first, last, head = (x[keep] for x in (place, first, last, head))
            doc = np.searchsorted(offsets, place, "right") - 1
            keys, raw = held.column(0).to_pylist(), memoryview(np.ascontiguousarray(data))
            full = [_digest(raw[a : b + match]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            rows.add(head.tolist(), full, [keys[d] for d in doc.tolist()], (first - offsets[doc]).tolist(), (last - offsets[doc]).tolist())
            yield from rows.ready()
        yield from rows.ready(1)

    return run


def _single_starts(match: int):
    """(full, key, lo, weight) of every start of the listed ranges; weight 2, without a key, stands for a string known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(full=pa.binary(), key=pa.binary(), lo=pa.int32(), weight=pa.int32())
        for batch in batches:
            for key, text, ranges in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw, name = memoryview(text.as_buffer()), key.as_py()
                for r in ranges:
                    lo, hi, weight = (r[f].as_py() for f in ("lo", "hi", "weight"))
                    every = list(range(lo, hi + 1))
                    owner = name if weight == 1 else None  # what is known to repeat is there to be met only
                    rows.add([_digest(raw[i : i + match]) for i in every], [owner] * len(every), every, [weight] * len(every))
                    yield from rows.ready()
        yield from rows.ready(1)

    return run


class SuffixArrays:
    """A family of suffix arrays (head) of which sizes double from level to level."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # (doublings, array), largest first

    def add(self, heads: DataFrame) -> DataFrame:
        """The heads that a batch shares with itself or with what came before, written; the batch becomes a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            size, two = self.levels.pop()
            _, one = self.levels.pop()
            self.levels.append((size + 1, write_and_reread(one.unionAll(two).distinct().orderBy("head"), "suffix-level")))
            _drop(one, two)
        counted = write_and_reread(heads.groupBy("head").agg((F.count(F.lit(1)) > 1).alias("twice")).orderBy("head"), "suffix-batch")
        shared = counted.filter("twice").select("head")
        array = counted.select("head")
        array.scratch_path = counted.scratch_path
        for _, level in self.levels:
            shared = shared.unionAll(array.join(level.hint("merge"), "head", "left_semi"))
        self.levels.append((0, array))
        return write_and_reread(shared.distinct(), "suffix-shared")


def _few(rows: DataFrame) -> DataFrame:
    """Rows of a key and no more, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _texts_with(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, text, ranges) of the texts that have a list; the others' texts aren't moved."""
    return texts.join(_few(lists.select("key")), "key", "left_semi").join(lists, "key").select("key", "text", "ranges", *[c for c in texts.columns if c not in ("key", "text")])


def repeated_starts(texts: DataFrame, match: int, window: int, batches: int) -> DataFrame:
    """(key, lo, hi): ranges of starts of strings that start anywhere else too; texts: key (16 bytes), text (binary).

    Ranges of texts that occur several times may be missing in part.
    """
    spark = texts.sparkSession
    heads = write_and_reread(in_batches(texts, _heads(match, window, batches), "batch int, head long"), "suffix-heads")
    family, found = SuffixArrays(), []
    for turn in range(batches):
        found.append(family.add(heads.filter(F.col("batch") == turn).select("head")))
    shared = found[0]
    for more in found[1:]:
        shared = shared.unionAll(more)
    bits = keyfilter.bits_for(shared.count())
    wanted = spark.sparkContext.broadcast(keyfilter.build(shared, "head", bits)) if bits else None
    _drop(heads, *[level for _, level in family.levels])
    held = in_batches(texts, _contexts(match, window, wanted), "head long, full binary, key binary, lo int, hi int")
    held = write_and_reread(held if bits else held.join(shared.distinct(), "head", "left_semi"), "suffix-contexts")
    each = write_and_reread(held.groupBy("head", "full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "hi")).alias("at")), "suffix-each")
    whole = write_and_reread(held.join(each.filter("n > 1").select("full"), "full", "left_semi").select("key", "lo", "hi"), "suffix-whole")
    # where a repeat ends, contexts of one head differ
    open_ = each.groupBy("head").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    ends = each.join(open_.select("head"), "head").select("at.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
    lists = write_and_reread(ends.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "weight")).alias("ranges")), "suffix-ends")
    _drop(*found, held, each)
    single = write_and_reread(in_batches(_texts_with(texts, lists).select("key", "text", "ranges"), _single_starts(match), "full binary, key binary, lo int, weight int"), "suffix-starts")
    dealt = single.repartition(max(8, single.count() // PART_ROWS), "full")  # small parts, for the sum and for the join
    twice = dealt.groupBy("full").agg(F.sum("weight").alias("n")).filter("n > 1").select("full")
    alone = write_and_reread(dealt.filter("weight = 1").join(twice.hint("merge"), "full", "left_semi").select("key", "lo", F.col("lo").alias("hi")), "suffix-alone")
    _drop(single)
    return whole.unionAll(alone)


def _drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        remove_path(table.sparkSession, table.scratch_path)


def without(text: memoryview, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, kept bytes) of a text, given the removed ranges [start, end)."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _cut(match: int, columns: list[str], judge: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                lo, hi = (ranges.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "hi"))
                made.append(judge(without(memoryview(text.as_buffer()), lo, hi + match)))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *map(pa.array, zip(*made, strict=True))], columns)

    return run


@scratched
def repeat_digest(docs: DataFrame, match: int = 400, window: int | None = None, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_removed, n_spans long, and kept_sha256 of the bytes that stay.

    A byte goes if a string of ``match`` bytes that covers it also starts anywhere else in
    the table, in the same text too. Null texts are empty; they and texts shorter than
    ``match`` lose nothing. Rows that repeat an id are judged row by row, and null ids are
    kept. Texts may have up to 256 MB. The order of rows and the number of batches don't
    change the result. An empty table gives no rows; other columns of any name are ignored.
    """
    window = window or match // 4
    if match - window < 8 or window < 1:
        raise ValueError("a match has to be at least 8 bytes longer than a window")
    bound_batches(docs)
    texts = docs.select(utf8(text_col).alias("text"), F.col(id_col).alias("doc_id")).withColumn("sha", F.sha2("text", 256))
    texts = texts.withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    rows = write_and_reread(texts.select("doc_id", "key", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "suffix-rows")
    copied = rows.filter(F.col("n_bytes") >= match).groupBy("key").count().filter("count > 1").select("key")
    starts = repeated_starts(texts.select("key", "text"), match, window, batches)
    marked = starts.join(_few(copied), "key", "left_anti")
    lists = write_and_reread(marked.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "suffix-marks")
    part = _texts_with(texts.select("key", "text", "doc_id"), lists)
    judge = lambda cut: (cut[0], cut[1], hashlib.sha256(cut[2]).hexdigest(), cut[0] + len(cut[2]))
    kind = dict(texts.dtypes)["doc_id"]
    cut = in_batches(part, _cut(match, ["doc_id", "n_removed", "n_spans", "kept_sha256", "n_bytes"], judge), f"doc_id {kind}, n_removed long, n_spans long, kept_sha256 string, n_bytes long")
    told = copied.withColumn("how", F.lit("copied")).unionAll(lists.select("key", F.lit("part").alias("how")))
    rest = rows.join(_few(told), "key", "left").filter("how is null or how = 'copied'")
    gone = F.col("how").isNotNull()
    whole = rest.select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.col("sha")).alias("kept_sha256"))
    return whole.unionByName(cut).withColumnRenamed("doc_id", id_col)
