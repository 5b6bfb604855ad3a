"""Lexical retrieval packing: windows of related documents from a sharded BM25 index.

Every text is encoded once and written with its ids. Documents are then dealt into shards
of about ``shard_tokens`` ids in the order of a minimum hash of their id pairs, so that
alike documents mostly share a shard, and a hash of id and text splits groups of
copies of any size. A shard builds its own inverted index. The document that opens a
window, or the one that the last window cut, is the seed: its strongest terms query the
index, and the best unused neighbours fill the window. What does not fit is cut and goes
on in the next window, so only a shard's last window needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm.text import U64, bound_batches, chunks, in_batches, mix, utf8
from lattica.llm.tokenstore import encoder, with_end
from lattica.operators.stats import prefix_sum
from lattica.session import scratched, write_and_reread

# The usual BM25 constants.
K1, B = 1.2, 0.75


def _encode(path: str, end_id: int, kind: str):
    """(doc_id, n, key, ids): the ids with the end id, and the minimum hash of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text", 1 << 20):
                ids, ptr = with_end(*encoder(path).encode(data, offsets), end_id)
                pairs = mix((ids[:-1].astype(U64) << U64(32)) + ids[1:], 31) if len(ids) > 1 else np.zeros(1, U64)
                pairs[ptr[1:-1] - 1] = np.iinfo(U64).max  # from one text to the next
                keys = np.minimum.reduceat(np.append(pairs, np.iinfo(U64).max), ptr[:-1]).view(np.int64)
                raw = ids.astype(kind).tobytes()
                spots = (ptr * np.dtype(kind).itemsize).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(spots.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(ptr)), pa.array(keys), held], ["doc_id", "n", "key", "ids"])

    return run


class Index:
    """A BM25 inverted index over the ids of one shard's documents."""

    def __init__(self, docs: list[np.ndarray], terms: int):
        self.size, self.terms = len(docs), terms
        length = np.array([len(x) for x in docs])
        kind = docs[0].dtype
        keys, count = np.unique((np.repeat(np.arange(self.size, dtype=np.int64), length) << 32) | np.concatenate(docs), return_counts=True)
        doc = keys >> 32
        self.term = (keys & 0xFFFFFFFF).astype(kind)  # 16 bits, where they suffice, sort fastest
        tf = count.astype(np.float32)
        lens = np.bincount(doc, minlength=self.size)
        df = np.bincount(self.term)
        idf = np.log1p((self.size - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * length / length.mean())).astype(np.float32)
        weight = idf[self.term] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        self.own = np.concatenate([[0], np.cumsum(lens)])
        self.weight = weight
        order = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, unused: np.ndarray, most: int) -> np.ndarray:
        """Unused documents by falling score for the seed's strongest terms, ties by position."""
        low, high = self.own[seed], self.own[seed + 1]
        strong = np.argsort(-self.weight[low:high], kind="stable")[: self.terms]
        terms = self.term[low:high][strong].astype(np.int64)
        first, last = self.post[terms], self.post[terms + 1]
        size = last - first
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.post_doc[at], self.post_weight[at], self.size) * unused
        found = np.flatnonzero(score > 0)
        if len(found) > most:
            found = np.sort(found[np.argpartition(-score[found], most - 1)[:most]])
        return found[np.argsort(-score[found], kind="stable")]


def retrieval_order(docs: list[np.ndarray], window: int, terms: int, most: int) -> list[int]:
    """Order in which a shard's documents are laid end to end."""
    index = Index(docs, terms)
    unused = np.ones(len(docs), bool)
    order: list[int] = []
    filled = cursor = 0
    seed = -1
    while len(order) < len(docs):
        if seed < 0:
            while not unused[cursor]:
                cursor += 1
            seed = cursor
            unused[seed] = False
            order.append(seed)
            filled += len(docs[seed])
        end = -(-filled // window) * window
        if filled == end:  # the seed just fills its window
            seed = -1
            continue
        last, asked = -1, most
        while filled < end and asked == most:  # a full answer may not be all: the rest is asked for again
            found = index.neighbours(seed, unused, most)
            asked = len(found)
            for near in found:
                unused[near] = False
                order.append(int(near))
                filled += len(docs[near])
                last = int(near)
                if filled >= end:
                    break
        # a cut document seeds the next window; without neighbours the next unused one does
        seed = last if last >= 0 and filled > end else -1
    return order


class Cuts:
    """Where shards begin in the order of keys: within a key's documents, at a share of their hashes."""

    def __init__(self, key: np.ndarray, share: np.ndarray):
        self.key, self.share = key, share

    def shard(self, key: np.ndarray, deal: np.ndarray) -> np.ndarray:
        half, share = (key.view(U64) >> U64(1)).view(np.int64), (deal.view(U64) >> U64(11)) / 2.0**53
        low, high = np.searchsorted(self.key, half), np.searchsorted(self.key, half, "right")
        out = low.copy()
        for i in np.flatnonzero(low < high).tolist():  # of a key that a cut splits
            out[i] += np.searchsorted(self.share[low[i] : high[i]], share[i], "right")
        return out


def shard_cuts(encoded: DataFrame, shard_tokens: int) -> Cuts:
    """Cuts that give each shard about ``shard_tokens`` ids; they follow from the rows alone, not from their order.

    Keys' sums are added up bucket by bucket; a cut falls into the key that holds the
    shard's first id. The driver sees a row a shard.
    """
    half = F.shiftrightunsigned("key", 1)
    sums = encoded.groupBy(half.alias("half")).agg(F.sum("n").alias("n"))
    run = prefix_sum(sums, "n", F.floor(F.log2(F.col("half") + 1.0) * 256), ["half"], "before")
    first, last = F.floor(F.col("before") / shard_tokens) + 1, F.floor((F.col("before") + F.col("n")) / shard_tokens)
    held = run.filter(first <= last).select("half", "before", "n", F.explode(F.sequence(first, last)).alias("s"))
    rows = sorted((r.half, r.s, (r.s * shard_tokens - r.before) / r.n) for r in held.collect())
    return Cuts(np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64))


def _deal(cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, deal = (batch.column(i).to_numpy() for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(cuts.value.shard(key, deal)), *batch.columns], ["shard", *batch.schema.names])

    return run


def _pack(window: int, terms: int, most: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = -1
        names: list = []
        docs: list[np.ndarray] = []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                if not len(part):
                    continue
                if shards[part[0]] != shard:
                    if docs:
                        yield packed_shard(shard, names, docs, window, terms, most)
                    shard, names, docs = int(shards[part[0]]), [], []
                names += batch.column(1).slice(part[0], len(part)).to_pylist()
                docs += [np.frombuffer(x.as_py(), kind) for x in batch.column(2).slice(part[0], len(part))]
        if docs:
            yield packed_shard(shard, names, docs, window, terms, most)

    return run


def packed_shard(shard: int, names: list, docs: list[np.ndarray], window: int, terms: int, most: int) -> pa.RecordBatch:
    """The pieces of one shard's documents."""
    rows: list[tuple] = []
    at = 0
    for i in retrieval_order(docs, window, terms, most):
        ids, done = docs[i].astype("<u4"), 0
        while done < len(ids):
            take = min(len(ids) - done, window - at % window)
            rows.append((names[i], done, take, zlib.crc32(ids[done : done + take].tobytes()), len(ids), (shard << 32) + at // window, at % window))
            done, at = done + take, at + take
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


@scratched
def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, shard_tokens: int = 1 << 21, terms: int = 32, most: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    Each id of each document lies in exactly one piece. A null or empty text is the end id
    alone; rows that repeat an id are documents of their own; null ids are kept. Ties of a
    score go to the document that comes first in its shard, and shards and their order
    follow from ids and texts alone, so the order of rows does not change the result. An empty table gives no rows,
    and only the id and text columns are read. A shard holds ``shard_tokens`` ids on
    average, and has to hold its longest document whole.
    """
    bound_batches(docs)
    kind = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    encoded = write_and_reread(in_batches(narrow, _encode(tokenizer_path, end_id, kind), "doc_id long, n long, key long, ids binary", "ids"), "packing-ids")
    cuts = shard_cuts(encoded, shard_tokens)
    # copies share a key, so the hash of their ids deals them out; rows equal in all may stand for each other
    placed = encoded.select("doc_id", "key", F.xxhash64("doc_id", "ids").alias("deal"), "ids")
    sharded = in_batches(placed, _deal(docs.sparkSession.sparkContext.broadcast(cuts)), "shard long, doc_id long, key long, deal long, ids binary")
    dealt = sharded.repartitionById(len(cuts.key) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "deal", "ids", "doc_id")
    return in_batches(dealt.select("shard", "doc_id", "ids"), _pack(window, terms, most, kind), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
