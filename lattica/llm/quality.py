"""Quality classifier: hashed word n-gram logistic regression with FTRL updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.linear import fit_chain, labelled_sample, score_chain
from lattica.llm.text import crc_mod


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8192, epochs: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Learns from at most ``sample`` labelled documents whose crc32(doc_id) mod 3 is not 1;
    only the text enters a score. Null and empty texts get the model's bias; without any
    usable label every score is 0.5. Repeated ids are scored row by row, a null id gives a
    null held_out, an empty table no rows, and other columns are ignored.
    """
    fitted = fit_chain(labelled_sample(docs, labels, [F.col(label_col)], id_col, text_col, sample), 1, epochs=epochs)
    scored = score_chain(docs, fitted, id_col, text_col, ["score"])
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
