"""Quality rules in DataFrame functions only: hashed n-gram log-likelihood ratios and base counts.

Words and word pairs are hashed into ``slots`` buckets. Two multinomials are estimated
with add-one smoothing: the target over trusted documents (labelled quality 1), the raw
one over every document. Every second trusted document is left out of
the target; those set the threshold, as the others score too well. A document's score is the sum of its buckets'
log ratios divided by its number of n-grams. Ratios are whole millionths, so sums, scores
and verdicts don't depend on the order of rows. A document passes when its score is not
below a cut between the left-out trusted documents and those labelled quality 0: the
cut that makes ``care`` times the share of the first that pass, plus the share of the second that
fail, largest. Both shares count documents that pass the base.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import crc_mod
from lattica.session import scratched, write_and_reread

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT = 1_000_000
# Score units between two cuts that are tried: half a thousandth.
STEP = 500


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for use several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), "")


def _grams(words: Column, slots: int) -> Column:
    """Buckets of all words and word pairs."""
    slot = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(slots)).cast("int")
    pairs = F.transform(words, lambda w, i: slot(w, F.get(words, i + 1)))
    return F.concat(F.transform(words, lambda w: slot(w)), F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside five-word windows that occur twice or more; ``hashes`` are the windows'."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def cover(s: Column) -> Column:
        twin = lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        add = lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, zero, add, lambda a: a["n"])

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(placed, cover)).otherwise(F.lit(0))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", text.alias("text"), _words("text").alias("words"), lines.alias("lines"))
    w = F.col("words")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    windows = F.when(F.size(w) >= 5, window).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    return counted.select("doc_id", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeated_words(w, F.col("windows")).cast("long").alias("n_repeat_words"))


def labelled_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, side) of every labelled id that may be learnt from: 0 labelled 0, 1 trusted and left out, 2 trusted and in the target."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    known = known.filter(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.select("doc_id", F.when(F.col("label") == 0, 0).otherwise(F.lit(2) - F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))).cast("int").alias("side"))


def best_cut(good: dict[int, int], bad: dict[int, int], care: float) -> int:
    """The cut for which ``care`` times the share of ``good`` (cut -> count) at or above it, plus the share of ``bad`` below it, is largest; the middle of the lowest range of such cuts."""
    cuts = sorted(good.keys() | bad.keys())
    all_good, all_bad = sum(good.values()), sum(bad.values())
    gains = []
    above, below = all_good, 0
    for cut in cuts:
        gains.append(care * above * all_bad + below * all_good)
        above, below = above - good.get(cut, 0), below + bad.get(cut, 0)
    best = gains.index(max(gains))
    return (cuts[best - 1] + 1 + cuts[best]) // 2 if best else cuts[0]


def log_ratios(docs: DataFrame, target_docs: DataFrame, slots: int) -> Column:
    """The model as an array literal of ``slots`` whole numbers: the log ratios in millionths."""

    def counts(rows: DataFrame) -> list[int]:
        out = [1] * slots
        for row in rows.select(_words("text").alias("words")).select(F.explode(_grams(F.col("words"), slots)).alias("slot")).groupBy("slot").count().collect():  # a row a slot
            out[row["slot"]] += row["count"]
        return out

    raw, target = counts(docs), counts(target_docs)
    all_raw, all_target = sum(raw), sum(target)
    ratios = [round(UNIT * math.log((t / all_target) / (n / all_raw))) for n, t in zip(raw, target, strict=True)]
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")


#: Labelled ids up to which they are broadcast (16 MB).
FEW_IDS = 1 << 20


@scratched
def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", slots: int = 16_384, sigmas: float = 6.0, care: float = 4.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: fewer than 10 words, or over a fifth of them in repeated windows. kept:
    not base_failed and a score of the threshold at least, which weighs a share of good
    documents lost ``care`` times as much as a share of bad ones kept. Without documents labelled 0
    it lies ``sigmas`` standard deviations below the left-out trusted documents' mean. A null text counts as empty:
    no words, base_failed. Repeated ids are judged row by row; without trusted documents
    nothing is known and every document that passes the base is kept. Null ids are judged
    too, an empty table gives no rows, and other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sides_of = labelled_ids(labels, id_col, label_col)
    # few ids are broadcast, so that no text is moved to find the labelled ones; written once, as the target's counts and then the cut read it
    sides_of = F.broadcast(sides_of) if sides_of.count() <= FEW_IDS else sides_of.hint("merge")
    known = write_and_reread(plain.join(sides_of, "doc_id").select("side", "text"), "rules-labelled")
    model = log_ratios(plain, known.filter("side = 2"), slots)

    def scored(rows: DataFrame) -> DataFrame:
        ratio = F.aggregate(_grams(F.col("words"), slots), F.lit(0).cast("long"), lambda a, s: a + F.get(model, s))
        n = F.greatest(2 * F.size("words") - 1, F.lit(1))
        return rows.withColumn("score_units", F.expr("0L") + F.floor(ratio / n).cast("long"))

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left_out = known.filter("side < 2").select(F.col("side").alias("doc_id"), "text")  # base_counts carries one column along
    wide = F.col("score_units").cast("decimal(38,0)")
    # a filter would be pushed into base_counts and repeat its work for every word
    tried = scored(base_counts(left_out)).select(F.col("doc_id").alias("good"), failed.alias("failed"), F.floor(F.col("score_units") / STEP).alias("cut"), "score_units").groupBy("good", "failed", "cut")
    sides: list[dict[int, int]] = [{}, {}]
    total = squares = 0
    for row in tried.agg(F.count(F.lit(1)).alias("n"), F.sum(wide).alias("total"), F.sum(wide * wide).alias("squares")).collect():  # at most two rows a side and cut
        if row["failed"]:
            continue
        sides[row["good"]][row["cut"]] = row["n"]
        if row["good"]:
            total, squares = total + int(row["total"]), squares + int(row["squares"])
    bad, good = sides
    least = -(1 << 62)
    if good and bad:
        least = STEP * best_cut(good, bad, care)
    elif good:
        n = sum(good.values())
        mean = total / n
        least = math.floor(mean - sigmas * math.sqrt(max(squares / n - mean * mean, 0.0)))
    judged = scored(base_counts(plain))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score_units") >= least)).alias("kept"), (F.col("score_units") / UNIT).alias("score"))
