"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter
trigram is bound as the product of the twice rotated first, the once rotated second and
the third letter's vector. A text's profile is the sum (bundle) of its trigram vectors; a
language's prototype is the sum of the profiles of its learning texts. The prediction is
the prototype with the highest cosine.

Letters are the lower-cased alphabetic code points; a run of anything else is one blank,
and a text begins and ends with a blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.sampling import hash_sample
from lattica.llm.text import U64, bound_batches, crc_mod, filter_rows, in_batches, kept, mix, text_runs

DIM = 1024
CACHE = 16_384
#: Languages whose prototypes are sent to the workers, at most.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"

_BMP: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-cased code points of the letters with single blanks (0) around their runs; empty without a letter."""
    if not _BMP:
        _BMP.append(np.array([chr(i).isalpha() for i in range(0xD800)] + [False] * 0x800 + [chr(i).isalpha() for i in range(0xE000, 0x10000)]))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _BMP[0][np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        ok[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    if not ok.any():
        return codes[:0]
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first character after a run stands for the blank
    out = np.where(ok, codes, 0)[keep]
    return np.concatenate([np.zeros(1, np.uint32), out] + ([] if out[-1] == 0 else [np.zeros(1, np.uint32)]))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams, as 63-bit numbers, and their counts."""
    own = letters(text).astype(U64)
    if len(own) < 3:
        return own[:0], np.zeros(0, np.int64)
    return np.unique((own[:-2] << U64(42)) | (own[1:-1] << U64(21)) | own[2:], return_counts=True)


class Space:
    """Trigram vectors, kept for up to ``CACHE`` trigrams."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letter: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dim), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            noise = mix(np.arange(self.dim // 64, dtype=U64) + U64(code * 1000003), 41)
            self.letter[code] = np.unpackbits(noise.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letter[code]

    def bound(self, gram: int) -> np.ndarray:
        a, b, c = (self._letter((gram >> s) & 0x1FFFFF) for s in (42, 21, 0))
        return np.roll(a, 2) * np.roll(b, 1) * c

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Row numbers of the trigrams' vectors."""
        if len(self.row) + len(grams) > CACHE and len(self.row) > CACHE // 2:
            self._clear()
        known, out = self.row, np.zeros(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            at = known.get(g)
            if at is None:
                at = known[g] = len(known)
                if at >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[at] = self.bound(g)
            out[i] = at
        return out

    def profile(self, text: str) -> np.ndarray | None:
        """Sum of the text's trigram vectors, None without a letter."""
        grams, counts = trigrams(text)
        if not len(grams):
            return None
        out = np.zeros(self.dim, np.float32)
        for at in range(0, len(grams), 1024):
            rows = self.rows(grams[at : at + 1024])
            out += counts[at : at + 1024].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return out


def space(dim: int) -> Space:
    held = kept("space")
    if dim not in held:
        held[dim] = Space(dim)
    return held[dim]


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, dim: int) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from at most ``per_language`` documents a language.

    Documents with a language and crc32(doc_id) mod 3 other than 1 are taken in whole hash
    buckets of their id, so the bound holds and every run takes the same ones. The driver
    sees the languages' names and the prototypes.
    """
    bound_batches(docs)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull())
    known = known.filter(F.coalesce(crc_mod("id", 3), F.lit(0)) != 1)
    names = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang_col} the language?")
    if not names:
        return [], np.zeros((0, dim), np.float32)
    sample = hash_sample(known, F.xxhash64("id"), per_language, "lang").select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, texts in text_runs(batch.column(1)):
                for i, text in enumerate(texts):
                    made = space(dim).profile(text)
                    if made is not None:
                        name = names[first + i]
                        sums[name] = sums.get(name, 0) + made.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    total = {name: np.zeros(dim) for name in names}
    for row in in_batches(sample.repartition(8), bundle, "lang string, sums array<double>", "space").collect():  # 8 rows a language
        total[row["lang"]] += np.array(row["sums"])
    made = np.array([total[n] for n in names])
    return names, (made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict(text: str, names: list[str], prototypes: np.ndarray, dim: int) -> tuple[str, float]:
    """(language, cosine) of one text."""
    made = space(dim).profile(text) if names else None
    if made is None:
        return UNKNOWN, 0.0
    near = prototypes @ made / max(float(np.linalg.norm(made)), 1e-9)
    best = int(near.argmax())
    return names[best], float(min(max(near[best], 0.0), 1.0))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, dim: int = DIM) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: not null, and with a letter, also when no language can be learnt.

    Empty texts go. Rows that repeat an id, and equal texts, are judged alike, each on its
    own, so ties don't arise; null ids are judged too. An empty table gives no rows, and
    columns of any name are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, per_language, dim))
    if not shared.value[0]:
        return filter_rows(docs, text_col, lambda: lambda texts: np.array([len(letters(t)) > 0 for t in texts], bool), "space")
    return filter_rows(docs, text_col, lambda: lambda texts: np.array([predict(t, *shared.value, dim)[0] != UNKNOWN for t in texts], bool), "space")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, dim: int = DIM) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (the cosine, 0 to 1).

    A null text and a text without a letter give ``und`` and 0, as does every text when no
    language can be learnt. Ties go to the language that sorts first. Repeated ids are
    predicted row by row, null ids are kept with a null held_out, an empty table gives no
    rows, and only the id, text and language columns are read, the last to learn alone.
    """
    names, prototypes = learn(docs, id_col, text_col, lang_col, per_language, dim)
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = shared.value
        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                found, score = zip(*[predict(t, names, prototypes, dim) for t in texts], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found), pa.array(score)], ["doc_id", "lang_pred", "score"])

    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = in_batches(inputs, run, "doc_id long, lang_pred string, score double", "space")
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
