"""Sparse linear models over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: its distinct words and word pairs, hashed into ``1 << BITS`` slots.
Words are runs of letters and digits in lower case, or runs of other visible characters.
On request the first bytes of each word take the place of the pairs, so that inflected
forms share a feature. A pair of equal words is one common feature, whatever the word. A word or repeat that
makes up a 64th, 16th or 4th of the text also sets a feature for that share. All
features are 0 or 1, and a score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.sampling import hash_sample
from lattica.llm.text import U64, Words, bound_batches, chunks, crc_mod, in_batches, mix, utf8

BITS = 18
SLOTS = 1 << BITS
REPEAT = U64(0x5EED)
SHARES = (64, 16, 4)


def features(data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """The distinct feature slots of each text. ``stems``: lengths of word heads, used instead of pairs."""
    words = Words(data, offsets, lower=True, words="marks")
    one = mix(words.hash, 1)
    same = words.hash[1:] == words.hash[:-1]
    two = np.where(same, mix(np.full(1, REPEAT), 2)[0], mix(words.hash[:-1] * U64(0x9E3779B97F4A7C15) + words.hash[1:], 3))
    heads = [mix(words.head(size), 20 + size) for size in stems]
    for i in range(len(offsets) - 1):
        low, high = words.ptr[i], words.ptr[i + 1]
        if low == high:
            yield np.zeros(0, np.int64)
            continue
        seen, count = np.unique(np.concatenate([one[low:high], *([h[low:high] for h in heads] or [two[low : high - 1]])]), return_counts=True)
        parts = [seen]
        for k, share in enumerate(SHARES):
            heavy = seen[count * share >= high - low] if high - low >= share else seen[:0]
            parts.append(mix(heavy, 10 + k))
        yield np.unique((np.concatenate(parts) >> U64(64 - BITS)).astype(np.int64))


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates and L1 shrinkage."""

    def __init__(self, slots: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(slots), np.zeros(slots)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def train(docs: list[np.ndarray], extra: np.ndarray, labels: np.ndarray, epochs: int) -> np.ndarray:
    """Weights: hashed slots, then one for each extra input, then the bias. Rows are taken in the given order."""
    k = extra.shape[1]
    model = Ftrl(SLOTS + k + 1)
    tail = np.arange(SLOTS, SLOTS + k + 1)
    for _ in range(epochs):
        for own, more, y in zip(docs, extra, labels, strict=True):
            model.update(np.concatenate([own, tail]), np.concatenate([np.ones(len(own)), more, [1.0]]), float(y))
    return model.weights(np.arange(SLOTS + k + 1))


def predict(own: np.ndarray, more: list[float], weights: np.ndarray) -> float:
    return float(sigmoid(weights[own].sum() + np.dot(weights[SLOTS:-1], more) + weights[-1]))


def train_chain(docs: list[np.ndarray], labels: np.ndarray, folds: int, epochs: int) -> np.ndarray:
    """Weights of each link of the chain (rows); a link also reads the earlier links' out-of-fold probabilities."""
    n, links = labels.shape
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    models = []
    for k in range(links):
        y = labels[:, k]
        weights = train(docs, earlier, y, epochs)
        models.append(np.concatenate([weights[:-1], np.zeros(links - k), weights[-1:]]))
        if k + 1 < links:
            held = np.zeros(n)
            for f in range(folds):
                rest = np.flatnonzero(fold != f)
                part = train([docs[i] for i in rest], earlier[rest], y[rest], epochs)
                for i in np.flatnonzero(fold == f):
                    held[i] = predict(docs[i], list(earlier[i]), part)
            earlier = np.column_stack([earlier, held])
    return np.array(models)


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[Column], id_col: str, text_col: str, most: int) -> DataFrame:
    """(order, text, y0, y1, ...): at most ``most`` labelled documents whose crc32(id) mod 3 is not 1.

    Documents are taken by the hash of their id, in whole hash buckets, so the bound holds
    and the choice is the same in every run. Labels of repeated ids count once (largest),
    and of documents that repeat an id the text with the smallest hash is taken; rows with
    a null label or id are left out.
    """
    names = [f"y{i}" for i in range(len(targets))]
    known = labels.select(F.col(id_col).alias("id"), *[t.cast("int").alias(n) for t, n in zip(targets, names, strict=True)]).dropna()
    known = known.filter(crc_mod("id", 3) != 1).groupBy("id").agg(*[F.max(n).alias(n) for n in names]).withColumn("h", F.xxhash64("id"))
    some = hash_sample(known, F.col("h"), most)
    bound_batches(docs)
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    held = texts.join(F.broadcast(some), "id")  # at most ``most`` ids
    one = held.groupBy("h", *names).agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("s"))  # a text for each id, however often it is repeated
    return one.select(F.col("h").alias("order"), F.col("s.text").alias("text"), *names)


def fit_chain(sample: DataFrame, links: int, folds: int = 3, epochs: int = 5, stems: tuple[int, ...] = ()) -> np.ndarray:
    """Train on the (bounded) sample in one task; returns a row of weights per link.

    Without labelled rows every weight is 0, so that every probability is a half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        labels: list[list[int]] = []
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                docs += features(data, offsets, stems)
                labels += zip(*[rows.column(2 + k).to_pylist() for k in range(links)], strict=True)
        if docs:
            made = train_chain(docs, np.array(labels, np.float64), folds, epochs)
            link, at = np.nonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array(link, pa.int32()), pa.array(at, pa.int32()), pa.array(made[link, at])], ["link", "at", "weight"])

    one = sample.repartition(1).sortWithinPartitions("order", "text")  # bounded by the sample's parameter
    out = np.zeros((links, SLOTS + links + 1))
    for row in in_batches(one, run, "link int, at int, weight double").collect():
        out[row["link"], row["at"]] = row["weight"]
    return out


def probabilities(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, stems: tuple[int, ...]) -> np.ndarray:
    """A row per text, a column per link."""
    links = len(model)
    out = np.zeros((len(offsets) - 1, links))
    for i, own in enumerate(features(data, offsets, stems)):
        for k in range(links):
            sums = float(model[k][own].sum(dtype=np.float64)) + float(model[k][-1])
            out[i, k] = sigmoid(sums + sum(float(model[k][SLOTS + j]) * out[i, j] for j in range(k)))
    return out


def score_chain(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, names: list[str], stems: tuple[int, ...] = ()) -> DataFrame:
    """doc_id and a probability per link for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    links = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                out = probabilities(data, offsets, model, stems)
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(out[:, k]) for k in range(links)]], ["doc_id", *names])

    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return in_batches(inputs, run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
