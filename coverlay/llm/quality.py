"""Quality classifier: supervised subword embeddings on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.llm.samples import held_out_flag, labelled_texts
from coverlay.llm.subword import Model, fit, softmax

#: Gradient steps of a training run, whatever the sample's size, and texts of a step.
STEPS, STEP_TEXTS = 450, 16


def passes(texts: int) -> int:
    return max(1, round(STEPS * STEP_TEXTS / max(texts, 1)))


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 400, folds: int = 5, held_out: int = 0, key: str = "doc_id", text: str = "text") -> Model:
    """Learns from at most ``per_class`` labelled texts of each class outside the held-out
    fold.  Nothing to learn from, as with an empty table, gives every text one half."""
    sample = labelled_texts(docs, labels, label, per_class, folds, held_out, key, text)
    if not sample:
        return Model((0, 1), np.zeros((1, 2)), np.zeros(2))
    return fit([t for t, _ in sample], [int(y) for _, y in sample], epochs=passes(len(sample)), batch=STEP_TEXTS)


def quality_score(model: Model, text: str = "text") -> Column:
    """Probability of label 1.  Null and empty texts have no features and get what the bias
    alone gives; equal texts score alike; long texts are read whole."""
    one = model.classes.index(1) if 1 in model.classes else None

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for part in parts:
            chance = softmax(scorer.logits(part.fillna("").tolist()))
            yield pd.Series(chance[:, one] if one is not None else np.zeros(len(part)))

    # Said to be nondeterministic so that filters on the score don't compute it again.
    return F.pandas_udf(score, "double").asNondeterministic()(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, accept: float = 0.3, folds: int = 5, held_out: int = 0, key: str = "doc_id", text: str = "text", **learning) -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``docs``, with or without a label.
    An empty table gives no rows.  Other columns are not read."""
    model = quality_model(docs, labels, folds=folds, held_out=held_out, key=key, text=text, **learning)
    scored = docs.select(key, held_out_flag(F.col(key), folds, held_out).alias("held_out"), quality_score(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
