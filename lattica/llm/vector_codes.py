"""Vectors as codes of entries, with codebooks fitted by Lloyd rounds and exponion search.

A vector is cut into equal parts and every part position has a codebook. To find a
part's nearest entry the search starts at the entry of the round before, at distance u.
An entry nearer than that, or as near with a smaller index, is within 2 u of the start,
so only the start's neighbours up to there are looked at, in the order of a list that is
sorted by distance once a round. Distances are squared and whole: d(start, e)**2 <= 4 u**2
decides without rounding.

A round is one scan that writes each row with its new codes, and one that sums the parts
of every entry task by task; only sums and codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import in_batches
from lattica.llm.vectors import extent, group_total, matrix, pack, unpack, whole_components
from lattica.session import remove_path, scratched, write_and_reread


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of every entry's neighbours, nearest first and ties by index, without itself."""
    gap = ((book[:, None] - book[None]) ** 2).sum(-1)
    np.fill_diagonal(gap, -1)
    order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(gap, order, 1)


def exponion(parts: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) nearest to each part, ties to the lower index, searched from its start entry."""
    best, far = start.astype(np.int64), ((parts - book[start]) ** 2).sum(1)
    order, gaps = neighbour_lists(book)
    for e in np.unique(start).tolist():
        at = np.flatnonzero(start == e)
        reach = np.searchsorted(gaps[e], 4 * far[at], "right")
        at = at[np.argsort(-reach, kind="stable")]
        reach = -np.sort(-reach)
        for k, other in enumerate(order[e].tolist()):
            near = at[: np.searchsorted(-reach, -k)]  # those that reach beyond k neighbours
            if not len(near):
                break
            d2 = ((parts[near] - book[other]) ** 2).sum(1)
            better = (d2 < far[near]) | ((d2 == far[near]) & (other < best[near]))
            best[near[better]], far[near[better]] = other, d2[better]
    return best, far


def _rows(batch: pa.RecordBatch, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(components by part, codes) of a batch with columns ..., whole, codes."""
    n = batch.num_columns
    return unpack(batch.column(n - 2), np.int32, (parts, width)).astype(np.int64), unpack(batch.column(n - 1), np.uint8, (parts,)).astype(np.int64)


def _assign(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, codes = _rows(batch, parts, width)
            error = np.zeros(len(values), np.int64)
            for p in range(parts):
                codes[:, p], far = exponion(values[:, p], codes[:, p], books[p])
                error += far
            kept = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pack(codes.astype(np.uint8)), pa.array(error)], ["vec_id", "label", "whole", "codes", "error"])

    return run


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            values, codes = _rows(batch, parts, width)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], values[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(count)
        cols = [pa.array(used[:, i], pa.int64()) for i in (0, 1)] + [pa.array(count[tuple(used.T)]), pa.array(total[tuple(used.T)].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "total"])

    return run


def _next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries are their parts' means, rounded down."""
    sums = in_batches(rows.select("whole", "codes"), _sums(books), "part long, entry long, n long, total array<long>")
    each = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", i).cast("decimal(38,0)")).alias(f"t{i}") for i in range(books.shape[2])])
    out = books.copy()
    for r in each.collect():  # a row an entry
        out[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(books.shape[2])]
    return out


@scratched
def encode_vectors(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label, label_error, codebooks_sha256) of every row with a finite vector.

    code: the entries' indexes in part order, two hex digits each; error: squared distances
    summed over parts; label_error: error summed over equal labels, nulls together. The
    codebooks start as the parts of the first ``entries`` rows by id (nulls last, ties by
    components) and the first search starts at entry 0. Entries that no part is nearest to
    stay. Vectors are filled with zeros to the longest one and to whole parts. Fewer rows
    than entries make smaller codebooks; an empty table gives no rows. Rows that repeat an
    id each have a code. Components may be up to 2**24 in absolute value. Other columns of
    any name are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    whole = whole_components(rows, scale, id_col, vector_col, label_col)
    n, dim, _ = extent(whole)
    width = max(1, -(-dim // parts))

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(2), parts * width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(values), pack(np.zeros((len(values), parts), np.uint8))], ["vec_id", "label", "whole", "codes"])

    kind = dict(whole.dtypes)["label"]
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).collect()
    books = np.zeros((parts, max(1, len(first)), width), np.int64)
    for e, r in enumerate(first):
        books[:, e] = np.pad(np.array(r.whole, np.int64), (0, parts * width - len(r.whole))).reshape(parts, width)
    state = write_and_reread(in_batches(whole, flatten, f"vec_id long, label {kind}, whole binary, codes binary"), "codes-rows")
    schema = f"vec_id long, label {kind}, whole binary, codes binary, error long"
    for _ in range(rounds):
        before, state = state, write_and_reread(in_batches(state.select("vec_id", "label", "whole", "codes"), _assign(books), schema), "codes-rows")
        remove_path(rows.sparkSession, before.scratch_path)
        books = _next_books(state, books)
    last = in_batches(state.select("vec_id", "label", "whole", "codes"), _assign(books), schema)
    told = ",".join(str(v) for v in books.reshape(-1).tolist()) if n else ""
    done = write_and_reread(last.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label"), "codes-last")
    return group_total(done, "label", F.col("error"), "label_error").withColumn("codebooks_sha256", F.lit(hashlib.sha256(told.encode()).hexdigest()))
