"""Binary token files: independent zstandard frames, a trailing seek table, checksums per frame.

File layout (little-endian; the frames and the seek table follow the public zstd seekable
format, so ordinary zstd tools can decompress a file):

* data frames, each holding whole documents: ``u32 n``, ``u8 null_id[n]``, ``i64 doc_id[n]``,
  ``u32 n_tokens[n]``, then the ids as ``u32``;
* a skippable frame with the document index: per data frame ``i64 first doc_id``, ``u32 n``;
* a skippable frame with the seek table: per data frame ``u32 compressed size``,
  ``u32 size``, ``u32`` low half of the XXH64 of the content; then ``u32 frames``,
  ``u8 0x80``, ``u32 0x8F92EAB1``.

Documents are in ascending doc_id order within and across files, null ids first. Ties of
doc_id are ordered by their text's hash, so that many rows of one id (or of none) spread
over files; repeated rows stay separate documents, a null or empty text
holds the end id alone, and an empty table gives no documents. Only the id and text
columns are read, so other columns of any name don't matter. One text has to fit the
memory of a worker; a frame holds one document at least.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.encode import RunEncoder
from lattica.llm.text import bound_batches, chunks, in_batches, kept, utf8
from lattica.session import scratch_path

# Fixed values of the zstd seekable format.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


def encoder(path: str) -> RunEncoder:
    """One encoder per worker process and tokenizer file."""
    held = kept("ids")
    if path not in held:
        held[path] = RunEncoder(path)
    return held[path]


def with_end(ids: np.ndarray, ptr: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ptr) with ``end_id`` after each text's ids."""
    out = np.full(len(ids) + len(ptr) - 1, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    ptr = ptr + np.arange(len(ptr))
    keep[ptr[1:] - 1] = False
    out[keep] = ids
    return out, ptr


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") or ":/" not in uri else uri.replace(":/", ":///", 1))


class FrameWriter:
    """Writes one file; ``level`` is the zstd level and ``frame_tokens`` the size of a frame."""

    def __init__(self, sink, level: int, frame_tokens: int):
        self.sink, self.frame_tokens = sink, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int]] = []
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.held = self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.held += len(ids)
        if self.held >= self.frame_tokens:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        names = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        nulls = np.array([d is None for d, _ in self.docs], np.uint8)
        sizes = np.array([len(x) for _, x in self.docs], "<u4")
        body = b"".join([struct.pack("<I", len(names)), nulls.tobytes(), names.tobytes(), sizes.tobytes(), *[x.astype("<u4").tobytes() for _, x in self.docs]])
        packed = self.packer.compress(body)
        self.sink.write(packed)
        self.table.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.index.append((int(names[0]), len(names)))
        self.n_docs += len(names)
        self.n_tokens += int(sizes.sum())
        self.docs, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<qI", *x) for x in self.index)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads one file; only the frames asked for are read and decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token file: seek table missing")
        source.seek(size - 9 - 12 * frames)
        self.table = list(struct.iter_unpack("<III", source.read(12 * frames)))
        self.offsets = np.concatenate([[0], np.cumsum([x[0] for x in self.table], dtype=np.int64)]).astype(np.int64)
        source.seek(int(self.offsets[-1]) + 8)
        self.index = list(struct.iter_unpack("<qI", source.read(12 * frames)))

    def frame(self, at: int) -> list[tuple[int | None, np.ndarray]]:
        packed, size, check = self.table[at]
        self.source.seek(int(self.offsets[at]))
        body = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if len(body) != size or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {at} differs")
        (n,) = struct.unpack_from("<I", body)
        nulls = np.frombuffer(body, np.uint8, n, 4)
        names = np.frombuffer(body, "<i8", n, 4 + n)
        ends = np.cumsum(np.frombuffer(body, "<u4", n, 4 + 9 * n), dtype=np.int64)
        ids = np.frombuffer(body, "<u4", int(ends[-1]), 4 + 13 * n)
        return [(None if nulls[i] else int(names[i]), ids[(ends[i - 1] if i else 0) : ends[i]]) for i in range(n)]

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document of that id, from the frames that can hold it."""
        found = []
        for at, (first, _) in enumerate(self.index):
            if first > doc_id:
                break
            if at + 1 < len(self.index) and self.index[at + 1][0] < doc_id:
                continue
            found += [ids for name, ids in self.frame(at) if name == doc_id]
        return found


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_tokens: int = 1 << 16, level: int = 3) -> DataFrame:
    """Encode every text and write the files; returns the manifest, already materialised.

    Manifest columns: part int (order of the files), path, n_docs long, n_tokens long. A
    file's name holds the attempt, and the manifest only lists attempts that succeeded, so
    a lost executor or a repeated task leaves an unlisted file at worst.
    """
    spark = docs.sparkSession
    bound_batches(docs)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), narrow.rdd.getNumPartitions())
    # the text and then the position part the rows of a common id or of none
    placed = narrow.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    keys = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text", "place").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        system, root = open_fs(out_dir)
        system.create_dir(root, recursive=True)
        path = f"{root}/part-{part:06d}-{context.taskAttemptId()}.tok.zst"
        with system.open_output_stream(path, compression=None) as sink:
            writer = FrameWriter(sink, level, frame_tokens)
            for batch in batches:
                for rows, data, offsets in chunks(batch, "text", 1 << 20):
                    ids, ptr = with_end(*encoder(tokenizer_path).encode(data, offsets), end_id)
                    for i, name in enumerate(rows.column(0).to_pylist()):
                        writer.add(name, ids[ptr[i] : ptr[i + 1]])
            writer.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": path.rsplit("/", 1)[1], "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = f"{out_dir.rstrip('/')}/manifest.parquet"
    in_batches(ordered, write, "part int, file string, n_docs long, n_tokens long", "ids").write.parquet(manifest)
    return spark.read.parquet(manifest).withColumn("path", F.concat(F.lit(out_dir.rstrip("/") + "/"), "file"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.filter("n_docs > 0").withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = open_fs(path)
                with system.open_input_file(place) as source:
                    reader = FrameReader(source)
                    for at in range(len(reader.table)):
                        docs = reader.frame(at)
                        sizes = np.array([len(x) for _, x in docs], np.int64)
                        starts = base + np.cumsum(sizes) - sizes
                        base += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(starts), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for _, x in docs], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return in_batches(placed.select("path", "base").repartition(parts, "path"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0, out_dir: str | None = None, **options) -> DataFrame:
    """Write the files of ``docs`` (to the shared folder by default), read them back and digest them."""
    out_dir = out_dir or scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, out_dir, tokenizer_path, end_id, **options))


