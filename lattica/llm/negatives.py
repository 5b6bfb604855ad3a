"""Hard negatives by bit-sliced integer products.

A vector of whole components is stored as bit-planes: word j holds bit j of every
component, the sign's plane first (two's complement). The product of an anchor q with a
row is the weighted sum of q's products with the row's planes. Planes are taken most
significant first. What the planes that are left can still add lies between
``rest * sum(min(q, 0))`` and ``rest * sum(max(q, 0))``, so every plane halves each pair's
score interval, and a pair goes as soon as its interval misses what can still qualify:
the anchor's running best rows, or the score bands of its positives. While most pairs are
alive a plane is multiplied with all anchors at once; the few that stay are finished pair
by pair, plane against plane, by counting common bits. All scores are exact integers.

Anchors are taken in groups of bounded size, each broadcast to one scan of all planes, so
neither vectors nor pairs are shuffled. Tasks keep the best few rows of each anchor and
of each of its positives, and one window merges the tasks' lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.text import U64, in_batches
from lattica.llm.vectors import extent, matrix, pack, unpack, whole_components
from lattica.session import scratched, write_and_reread

#: Anchors that one scan serves, about; they are broadcast with their positives.
GROUP = 8192
#: Pairs that a task handles at once.
PAIRS = 1 << 20
#: Pairs for one task, about.
TASK_PAIRS = 1 << 28
#: Below this share of pairs alive, they are finished one by one.
SPARSE = 1 / 16


def to_planes(whole: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, words): plane 0 is the sign, the last one the lowest bit."""
    n, dim = whole.shape
    words = max(1, -(-dim // 64))
    out = np.zeros((n, bits, words), U64)
    for j in range(bits):
        held = np.zeros((n, words * 64), bool)
        held[:, :dim] = (whole >> (bits - 1 - j)) & 1
        out[:, j] = np.packbits(held, axis=1, bitorder="little").view(U64)
    return out


def weights(bits: int) -> np.ndarray:
    """What a bit of each plane counts."""
    out = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    out[0] = -out[0]
    return out


def plane_bits(plane: np.ndarray) -> np.ndarray:
    """(rows, 64 * words) of zeros and ones."""
    return np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little")


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The whole components again, padded to whole words."""
    return sum(w * plane_bits(planes[:, j]).astype(np.int64) for j, w in enumerate(weights(planes.shape[1]).tolist()))


class Anchors:
    """A group's anchors: planes, components and the sums that bound their products."""

    def __init__(self, planes: np.ndarray):
        self.planes = planes
        whole = from_planes(planes)
        self.whole = whole.astype(np.float64)  # sums of products are exact below 2**53, which WIDEST and exact() see to
        self.least, self.most = np.minimum(whole, 0).sum(1), np.maximum(whole, 0).sum(1)

    def products(self, at: np.ndarray, rows: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs alive whose score can lie in the anchor's range [low, high].

        at: the anchors' numbers; rows: planes of rows; alive: mask (anchors, rows); the
        returned anchors and rows count within at and rows.
        """
        value = weights(rows.shape[1])
        left = len(value)
        part = np.zeros(alive.shape)
        q, least, most = self.whole[at], self.least[at], self.most[at]
        while left and np.count_nonzero(alive) > SPARSE * alive.size:
            j = len(value) - left
            part += float(value[j]) * (q @ plane_bits(rows[:, j]).T.astype(np.float64))
            left -= 1
            rest = (1 << left) - 1
            alive &= (part + (rest * most)[:, None] >= low[:, None]) & (part + (rest * least)[:, None] <= high[:, None])
        one, two = np.nonzero(alive)
        score = part[one, two].astype(np.int64)
        for j in range(len(value) - left, len(value)):
            plane = rows[two, j]
            for i, w in enumerate((value * value[j]).tolist()):
                score += w * np.bitwise_count(plane & self.planes[at[one], i]).sum(1, dtype=np.int64)
            rest = (1 << (len(value) - 1 - j)) - 1
            keep = (score + rest * most[one] >= low[one]) & (score + rest * least[one] <= high[one])
            one, two, score = one[keep], two[keep], score[keep]
        return one, two, score


class Best:
    """The first ``most`` (score, id) of each key: higher scores first, ties by smaller id."""

    def __init__(self, keys: int, most: int):
        self.most = most
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(keys, -(1 << 62))  # what a new score has to reach

    def add(self, key: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        key, score, name = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.id, name)))
        order = np.lexsort((name, -score, key))
        key, score, name = key[order], score[order], name[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
        keep = rank < self.most
        self.key, self.score, self.id = key[keep], score[keep], name[keep]
        full = rank == self.most - 1
        self.last[key[full]] = score[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.key), pa.array(self.score), pa.array(self.id)], ["key", "score", "id"])


def _blocks(batches: Iterator[pa.RecordBatch], shape: tuple[int, int], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, planes) of runs of rows."""
    for batch in batches:
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        planes = unpack(batch.column(2), U64, shape)
        for row in range(0, len(ids), size):
            part = slice(row, row + size)
            yield ids[part], labels[part], planes[part]


def _positives(group, shape: tuple[int, int], most: int):
    """The best rows of each anchor's label, but for itself: key is the anchor's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, planes = group.value
        anchors, best = Anchors(planes), Best(len(names), most)
        order = np.argsort(own, kind="stable")
        high = np.full(len(names), 1 << 62)
        for ids, labels, rows in _blocks(batches, shape, max(64, PAIRS // len(names))):
            for label in np.unique(labels).tolist():
                at = order[np.searchsorted(own[order], label) : np.searchsorted(own[order], label, "right")]
                here = np.flatnonzero(labels == label)
                if len(at):
                    one, two, score = anchors.products(at, rows[here], names[at][:, None] != ids[here][None, :], best.last[at], high[at])
                    best.add(at[one], score, ids[here][two])
        yield best.batch()

    return run


def _negatives(group, shape: tuple[int, int], most: int):
    """The best rows of other labels within each positive's band: key is the positive's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, planes, owner, floor, ceiling = group.value  # positives in their anchors' order
        anchors, best = Anchors(planes), Best(len(owner), most)
        has = np.unique(owner)
        first = np.searchsorted(owner, has)
        count = np.diff(first, append=len(owner))
        top = np.maximum.reduceat(ceiling, first) if len(has) else first
        for ids, labels, rows in _blocks(batches, shape, max(64, PAIRS // max(1, len(has)))):
            if not len(has):
                break
            bound = np.minimum.reduceat(np.maximum(floor, best.last), first)
            one, two, score = anchors.products(has, rows, own[has][:, None] != labels[None, :], bound, top)
            n = count[one]
            at = np.repeat(first[one] - np.cumsum(n) + n, n) + np.arange(n.sum())
            two, score = np.repeat(two, n), np.repeat(score, n)
            keep = (score >= np.maximum(floor, best.last)[at]) & (score <= ceiling[at])
            best.add(at[keep], score[keep], ids[two[keep]])
        yield best.batch()

    return run


def _merged(rows: DataFrame, most: int) -> DataFrame:
    """The tasks' lists as one: adds rank from 1."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", turn).filter(F.col("rank") <= most)


@scratched
def mine_hard_negatives(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 10, band: tuple[int, int, int] = (30, 90, 100), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    anchors: which rows are anchors, a condition on vec_id. An anchor's positives are its
    first rows of the same label by score, its negatives for a positive the first rows of
    other labels whose score is ``band[0]`` to ``band[1]`` parts in ``band[2]`` of the
    positive's; ties go to the smaller id. Rows with a null id, label or vector, or a
    component that is null or not finite, take no part. Of rows that repeat an id, the
    smallest by label and components counts. Shorter vectors end in zeros. Anchors without
    positives, and positives without negatives, give no rows, nor does an empty table.
    Components may be up to 2**24 in absolute value. Other columns of any name are ignored.
    """
    spark = rows.sparkSession
    whole = whole_components(rows, scale, id_col, vector_col, label_col).filter("vec_id is not null and label is not null")
    n, dim, widest = extent(whole)
    bits, words = widest.bit_length() + 1, max(1, -(-dim // 64))
    if dim and 2 * (bits - 1) + dim.bit_length() > 52:
        raise ValueError(f"products of {dim} components of {bits} bits are beyond exact sums")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(to_planes(matrix(batch.column(2), dim), bits))], ["vec_id", "label", "planes"])

    made = in_batches(whole.select("vec_id", F.col("label").cast("long").alias("label"), "whole"), encode, "vec_id long, label long, planes binary")
    once = made.groupBy("vec_id").agg(F.min(F.struct("label", "planes")).alias("r")).select("vec_id", "r.label", "r.planes")
    codes = write_and_reread(once, "negatives-planes")
    chosen = codes.withColumnRenamed("vec_id", id_col).filter(anchors).withColumnRenamed(id_col, "vec_id")
    n_anchors = chosen.count()
    groups = -(-n_anchors // GROUP)
    dealt = codes.repartition(max(spark.sparkContext.defaultParallelism, -(-n * min(n_anchors, GROUP) // TASK_PAIRS)))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for turn in range(groups):
        held = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == turn).orderBy("vec_id").collect()  # about GROUP rows
        if not held:
            continue
        names, own = (np.array([r[i] for r in held], np.int64) for i in (0, 1))
        planes = np.stack([np.frombuffer(r.planes, U64).reshape(bits, words) for r in held])
        group = spark.sparkContext.broadcast((names, own, planes))
        found = _merged(in_batches(dealt, _positives(group, (bits, words), positives), "key long, score long, id long", "negatives"), positives)
        best = sorted((r.key, r["rank"], r.score, r.id) for r in found.collect())  # GROUP times the positives at most
        owner, _, score, name = (np.array([b[i] for b in best], np.int64) for i in range(4))
        low, high, whole_band = band
        group2 = spark.sparkContext.broadcast((own, planes, owner, -(-low * score // whole_band), high * score // whole_band))
        lists = _merged(in_batches(dealt, _negatives(group2, (bits, words), negatives), "key long, score long, id long", "negatives"), negatives)
        told = spark.createDataFrame([(k, int(names[a]), int(p), int(s)) for k, (a, p, s) in enumerate(zip(owner, name, score, strict=True))], "key long, anchor_id long, positive_id long, positive_score long")
        part = lists.join(F.broadcast(told), "key")  # GROUP times the positives at most
        out = out.unionByName(write_and_reread(part.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-part"))
        group.unpersist(), group2.unpersist()
    return out
