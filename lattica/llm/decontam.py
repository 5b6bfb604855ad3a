"""Benchmark decontamination: every passage queries a BM25 index of the test items by block-max WAND.

A passage is a window of ``window`` words, half of it shared with the next. Terms are
pairs of neighbouring words, as single words of a test item are in most passages of its
language; only an item of one word has that word as its term. A passage's score for an item is the BM25 sum of the item's weights for the
passage's distinct terms, divided by the same sum for all of the item's terms, so 1
means that every term of the item is in the passage. All items that reach ``threshold`` are retrieved: a passage whose best
possible sum is too small is passed over; for the others, WAND moves from pivot to pivot
and the largest weight of each block of items rules out blocks. An item longer than a
passage is indexed as overlapping segments, each with its own sum, and its score is its best
segment's: a segment of half a window and a word is whole in some passage wherever it
stands, so a copy of an item of any length is retrieved. Retrieved pairs are
verified on word n-grams of the passage with as many words around it as the item has:
both the item's question and its answer have to be there. The question is the first
three quarters of the words, the answer the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import U64, Words, bound_batches, chunks, filter_rows, in_batches, joined, mix, new_key, utf8

# The usual BM25 constants.
K1, B = 1.2, 0.75
BLOCK = 16


def _hashes(text: str, key: bytes | None = None) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), words="alnum", key=key).hash.tolist()


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """A term for each word and the next."""
    return mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:], 51)


def _singles(hashes: np.ndarray) -> np.ndarray:
    """A term for each word, for items of one word."""
    return mix(hashes, 52)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(len(hashes) - size + 1, 0)
    value = np.zeros(n, U64)
    for k in range(size):
        value = mix(value * U64(0x9E3779B97F4A7C15) + hashes[k : k + n], 60 + k)
    return value


def segments(n: int, window: int, threshold: float) -> list[tuple[int, int]]:
    """(first word, end) of the parts under which an item of ``n`` words is indexed; every pair of words is in one.

    At most ``window`` words are held by two passages, so one of them holds half of the sum,
    and they stay whole where half is enough.
    """
    size = window // 2 + 1
    if n <= (window if threshold <= 0.5 else size):
        return [(0, n)]
    return [(at, at + size) for at in [*range(0, n - size, max(size // 2, 1)), n - size]]


class ItemIndex:
    """Postings of the items' segments' terms with normalised BM25 weights, and their maxima by term and by block.

    Words are known by hashes with a secret key of the index, so no text can be made to
    look like an item.
    """

    def __init__(self, items: list[tuple[int, str]], grams: int, window: int = 64, threshold: float = 0.4):
        self.ids = [i for i, _ in items]
        self.grams = grams
        self.key = new_key()
        self.words = [_hashes(t, self.key) for _, t in items]
        #: (n-gram size, distinct n-grams) of each item's question and of its answer
        self.parts: list[tuple[tuple[int, np.ndarray], ...]] = []
        for own in self.words:
            cut = min(-(-3 * len(own) // 4), max(len(own) - 1, 1))
            told = [np.array(x, U64) for x in (own[:cut], own[cut:] or own)]
            self.parts.append(tuple((min(grams, len(x)), np.unique(_grams(x, min(grams, len(x))))) for x in told))
        n = len(items)
        self.item: list[int] = []  # of each segment
        terms: list[list[int]] = []
        tf: list[dict[int, int]] = []
        df: dict[int, int] = {}
        for i, own in enumerate(self.words):
            held = np.array(own, U64)
            pairs = (_pairs if len(own) > 1 else _singles)(held).tolist()
            for low, high in segments(len(own), window, threshold):
                self.item.append(i)
                terms.append(pairs[low : max(high - 1, 1)])
                count: dict[int, int] = {}
                for w in terms[-1]:
                    count[w] = count.get(w, 0) + 1
                tf.append(count)
            for w in set(pairs):
                df[w] = df.get(w, 0) + 1
        mean = max(sum(map(len, terms)) / max(len(terms), 1), 1)
        self.singles = any(len(own) == 1 for own in self.words)
        self.vocabulary = np.array(sorted(df), np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary >> U64(48)).astype(np.int64)] = True
        number = {w: i for i, w in enumerate(self.vocabulary.tolist())}
        postings: list[list[tuple[int, float]]] = [[] for _ in number]
        for i, count in enumerate(tf):
            weight = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(terms[i]) / mean)) for w, c in count.items()}
            whole = sum(weight.values())
            for w, x in weight.items():
                postings[number[w]].append((i, x / whole))
        self.postings = [([i for i, _ in p], [x for _, x in p]) for p in postings]
        self.most = np.array([max(x) for _, x in self.postings], np.float64)
        self.blocks = [self._block_maxima(p) for p in postings]

    @staticmethod
    def _block_maxima(posting: list[tuple[int, float]]) -> dict[int, float]:
        out: dict[int, float] = {}
        for i, x in posting:
            out[i // BLOCK] = max(out.get(i // BLOCK, 0.0), x)
        return out

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (segment, score) with a score of at least ``threshold``, by block-max WAND over the distinct terms."""
        slack = threshold - 1e-9
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]  # current item, position, term
        found = []
        while cursors:
            cursors.sort()
            total = 0.0
            pivot = -1
            for k, (_, _, t) in enumerate(cursors):
                total += self.most[t]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) < slack:
                # nothing before the block's end, or before the next list's item, can reach the threshold
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                move = range(pivot + 1)
            elif cursors[0][0] == item:
                score = sum(self.postings[t][1][p] for _, p, t in cursors[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                to, move = item + 1, range(pivot + 1)
            else:
                to, move = item, range(pivot)
            for k in move:
                cursor = cursors[k]
                items = self.postings[cursor[2]][0]
                while cursor[1] < len(items) and items[cursor[1]] < to:
                    cursor[1] += 1
                cursor[0] = items[cursor[1]] if cursor[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verify(self, item: int, around: Callable[[int], np.ndarray]) -> tuple[float, float]:
        """Shares of the question's and of the answer's n-grams in a stretch of words; ``around``: its n-grams of a size."""
        return tuple(float(np.isin(own, around(size)).mean()) for size, own in self.parts[item])


def passages(words: Words, index: ItemIndex, window: int, threshold: float) -> Iterator[tuple[int, int, list[int]]]:
    """(document, first word in it, distinct index terms) of each passage whose bound reaches the threshold."""
    if not len(index.vocabulary) or not len(words.hash):
        return
    stride = window // 2
    counts = np.diff(words.ptr)
    pairs = _pairs(words.hash)
    last = np.zeros(len(pairs) + 1, bool)  # a document's last word has no next
    last[words.ptr[1:][counts > 0] - 1] = True

    def known(hashes: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, word) of those in the index."""
        spot = spot[index.maybe[(hashes[spot] >> U64(48)).astype(np.int64)]]
        term = np.searchsorted(index.vocabulary, hashes[spot])
        term[term == len(index.vocabulary)] = 0
        hit = index.vocabulary[term] == hashes[spot]
        return term[hit], spot[hit]

    term, spot = known(pairs, np.flatnonzero(~last[:-1]))
    if index.singles:
        more = known(_singles(words.hash), np.arange(len(words.hash)))
        term, spot = np.concatenate([term, more[0]]), np.concatenate([spot, more[1]])
        order = np.argsort(spot, kind="stable")
        term, spot = term[order], spot[order]
    doc = np.repeat(np.arange(len(counts)), counts)[spot]
    at = spot - words.ptr[doc]
    # the term's earlier place in its document; a term counts once in a passage
    order = np.lexsort((at, term, doc))
    before = np.full(len(spot), -1)
    same = (doc[order[1:]] == doc[order[:-1]]) & (term[order[1:]] == term[order[:-1]])
    before[order[1:][same]] = at[order[:-1][same]]
    n_windows = np.maximum(1, -(-(counts - window) // stride) + 1)
    first = np.concatenate([[0], np.cumsum(n_windows)])
    bound = np.zeros(first[-1])
    for back in (0, 1):
        k = at // stride - back
        ok = (k >= 0) & (k < n_windows[doc]) & (before < k * stride)
        bound += np.bincount(first[doc[ok]] + k[ok], index.most[term[ok]], len(bound))
    for w in np.flatnonzero(bound >= threshold - 1e-9).tolist():
        d = int(np.searchsorted(first, w, "right")) - 1
        start = (w - int(first[d])) * stride
        low, high = np.searchsorted(spot, [words.ptr[d] + start, min(words.ptr[d] + start + window, words.ptr[d + 1])])
        yield d, start, np.unique(term[low:high]).tolist()


def find(data: np.ndarray, offsets: np.ndarray, index: ItemIndex, window: int, threshold: float, overlap: float) -> dict[tuple[int, int], tuple]:
    """(document, item) -> (score, question overlap, answer overlap, first word) of the best verified passage, the earliest of equal ones."""
    best: dict[tuple[int, int], tuple] = {}
    words = Words(data, offsets, words="alnum", key=index.key)
    seen: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for d, start, terms in passages(words, index, window, threshold):
        scores: dict[int, float] = {}
        for segment, score in index.search(terms, threshold):
            item = index.item[segment]
            scores[item] = max(scores.get(item, 0.0), score)
        for item, score in scores.items():
            seen.setdefault((d, item), []).append((-score, start))
    grams: dict[int, np.ndarray] = {}  # of one document at a time, by size
    of = -1
    for (d, item), places in sorted(seen.items()):
        if d != of:
            of, grams = d, {}
        whole, size = words.hash[words.ptr[d] : words.ptr[d + 1]], len(index.words[item])

        def around(n: int, low: int, high: int, whole: np.ndarray = whole, grams: dict[int, np.ndarray] = grams) -> np.ndarray:
            if n not in grams:
                grams[n] = _grams(whole, n)
            return grams[n][low : max(high - n + 1, low)]

        for score, start in sorted(places):
            low, high = max(start - size, 0), min(start + window + size, len(whole))
            asked, answered = index.verify(item, lambda n: around(n, low, high))  # noqa: B023
            if asked >= overlap and answered >= overlap:
                best[d, item] = (-score, asked, answered, start)
                break
    return best


def _scan(shared, window: int, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            out = []
            for rows, data, offsets in chunks(batch, "text"):
                names = rows.column(0).to_pylist()
                out += [(names[d], index.ids[i], *x) for (d, i), x in find(data, offsets, index, window, threshold, overlap).items()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return run


def _indexes(items: DataFrame, item_col: str, item_text: str, grams: int, index_items: int, window: int, threshold: float) -> Iterator[ItemIndex]:
    """Indexes of at most ``index_items`` segments each, or one item."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len(_hashes(row["t"])) if row["t"] else 0
        if not n:
            continue
        more = len(segments(n, window, threshold))
        if held and size + more > index_items:
            yield ItemIndex(held, grams, window, threshold)
            held, size = [], 0
        held.append((row["i"], row["t"]))
        size += more
    if held:
        yield ItemIndex(held, grams, window, threshold)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 64, threshold: float = 0.4, overlap: float = 0.5, grams: int = 3, index_items: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item.

    Null and empty texts stay, as does every row where there are no items; items without a
    word are ignored. Rows that repeat an id, and equal texts, are judged alike, each on its
    own; an empty table gives no rows. Columns of any name are kept as they are.
    """

    def judge(shared):
        def passes(texts: list[str]) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[d for d, _ in find(*joined(texts), shared.value, window, threshold, overlap)]] = False
            return keep

        return lambda: passes

    for index in _indexes(items, item_col, item_text, grams, index_items, window, threshold):
        docs = filter_rows(docs, text_col, judge(docs.sparkSession.sparkContext.broadcast(index)))
    return docs


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 64, threshold: float = 0.4, overlap: float = 0.5, grams: int = 3, index_items: int = 20_000) -> DataFrame:
    """A row per contaminated pair: doc_id, item_id, score, question_overlap, answer_overlap, first_word (of the best passage).

    Items are indexed ``index_items`` segments at a time (an item of up to ``window`` words is
    one), so what is broadcast is bounded, and the
    documents are read once per index. Null and empty texts, and items without a word, are
    in no pair; an item of one word is in every text with that word. Rows that repeat a doc_id or an item_id give their own rows; ties of a
    score take the earlier passage. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(docs)
    kinds = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    parts = [in_batches(inputs, _scan(spark.sparkContext.broadcast(index), window, threshold, overlap), kinds) for index in _indexes(items, item_col, item_text, grams, index_items, window, threshold)]
    out = parts[0] if parts else spark.createDataFrame([], kinds)
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
