"""Toxicity by classifier chains of linear models with out-of-fold inputs.

The categories are predicted one after the other. A later category's model also reads
the probabilities of the earlier ones; while it trains these come from models that did
not see the document (out of fold), as at scoring time.

The tables label two categories, so the chain of the registered query has two links:
low quality (which marks spam and noise), then toxic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.linear import fit_chain, labelled_sample, probabilities, score_chain
from lattica.llm.text import crc_mod, filter_rows, joined


def _categories(given: dict[str, Column] | None) -> dict[str, Column]:
    return given or {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}


def keep_harmless(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = 8192, folds: int = 3, epochs: int = 5, stems: tuple[int, ...] = (4, 5), threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose last category's probability is below ``threshold``.

    Null and empty texts get the models' biases; without usable labels every row stays.
    Rows that repeat an id, and equal texts, are judged alike, each on its own; a
    probability that equals the threshold rejects. Null ids are judged too, an empty table
    gives no rows, and columns of any name are kept as they are.
    """
    chain = _categories(categories)
    fitted = fit_chain(labelled_sample(docs, labels, list(chain.values()), id_col, text_col, sample), len(chain), folds, epochs, stems)
    shared = docs.sparkSession.sparkContext.broadcast(fitted.astype(np.float32))
    # without labels every probability is a half and nothing is rejected
    return filter_rows(docs, text_col, lambda: lambda texts: probabilities(*joined(texts), shared.value, stems)[:, -1] < threshold) if fitted.any() else docs


def toxicity_scores(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = 8192, folds: int = 3, epochs: int = 5, stems: tuple[int, ...] = (4, 5)) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, a probability per category in chain order, score and predicted of the last.

    ``categories``: name -> 0/1 expression over ``labels``, in chain order. Learns from at
    most ``sample`` labelled documents whose crc32(doc_id) mod 3 is not 1. Null and empty
    texts get the models' biases; without labels every probability is 0.5. Repeated ids
    are scored row by row, null ids are kept, an empty table gives no rows, and other
    columns are ignored.
    """
    categories = _categories(categories)
    names = [f"p_{n}" for n in categories]
    fitted = fit_chain(labelled_sample(docs, labels, list(categories.values()), id_col, text_col, sample), len(names), folds, epochs, stems)
    scored = score_chain(docs, fitted, id_col, text_col, names, stems)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), *names, F.col(names[-1]).alias("score"), (F.col(names[-1]) >= 0.5).cast("int").alias("predicted"))
