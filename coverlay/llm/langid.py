"""Language identification: averaged hashed subword vectors, softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.llm.quality import STEP_TEXTS, passes
from coverlay.llm.samples import held_out_flag, labelled_texts
from coverlay.llm.subword import Model, fit, softmax

UNKNOWN = "und"
#: A softmax this sure of anything is not sharpened further.
SHARPEST = 0.25


def calibrate(model: Model, texts: Sequence[str], labels: Sequence[str], lost: float) -> tuple[float, float]:
    """Temperature with the best likelihood on texts that the model has not seen, and the
    probability below which a prediction is rejected: ``lost`` of the right ones fall below
    it at most, and never one of a half or more."""
    known = [(t, y) for t, y in zip(texts, labels, strict=True) if y in model.classes]
    if not known:
        return 1.0, 0.0
    logits = model.scorer().logits([t for t, _ in known])
    wanted = np.array([model.classes.index(y) for _, y in known])
    rows = np.arange(len(known))
    grid = SHARPEST * 2 ** (np.arange(25) / 4)
    temperature = min(grid, key=lambda t: -np.log(np.maximum(softmax(logits / t)[rows, wanted], 1e-12)).mean())
    chance = softmax(logits / temperature)
    right = np.sort(chance.max(1)[chance.argmax(1) == wanted])
    return float(temperature), min(float(right[int(lost * len(right))]), 0.5) if len(right) else 0.0


@dataclass(frozen=True)
class Identifier:
    """A model, its temperature, and the probability below which it rejects.  Without a
    model, as nothing was labelled, every text is ``und`` with score 0 and rejected."""

    model: Model | None
    temperature: float
    least: float

    def judge(self, text: str = "text") -> Column:
        """``struct<lang, score, rejected>``.  Texts that are null, empty or without letters
        are ``und`` with score 0 and rejected; texts whose best probability is below the
        calibrated one are rejected.  Equal texts are judged alike; long ones are read whole."""
        if self.model is None:
            return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

        def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scorer, names = self.model.scorer(), np.array(self.model.classes, dtype=object)
            for part in parts:
                texts = part.fillna("").tolist()
                chance = softmax(scorer.logits(texts) / self.temperature)
                blank = np.array([not any(map(str.isalpha, t)) for t in texts], bool)
                score = np.where(blank, 0.0, chance.max(1))
                lang = np.where(blank, UNKNOWN, names[chance.argmax(1)])
                yield pd.DataFrame({"lang": lang, "score": score, "rejected": blank | (score < self.least)})

        # Said to be nondeterministic so that filters on the result don't compute it again.
        return F.pandas_udf(judge, "lang string, score double, rejected boolean").asNondeterministic()(F.col(text))


def identifier(docs: DataFrame, label: str = "lang", per_class: int = 200, folds: int = 4, held_out: int = 2, lost: float = 0.002, key: str = "doc_id", text: str = "text") -> Identifier:
    """Learns from at most ``per_class`` texts of each language outside the held-out fold and
    calibrates on a quarter of them that the model doesn't see."""
    sample = labelled_texts(docs.select(key, text), docs.select(key, label), label, per_class, folds, held_out, key, text)
    if not sample:
        return Identifier(None, 1.0, 0.0)
    learned = [row for i, row in enumerate(sample) if i % 4] or sample
    model = fit([t for t, _ in learned], [y for _, y in learned], epochs=passes(len(learned)), batch=STEP_TEXTS)
    return Identifier(model, *calibrate(model, [t for t, _ in sample[::4]], [y for _, y in sample[::4]], lost))


def predict_language(docs: DataFrame, folds: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text", **learning) -> DataFrame:
    """``key, held_out, lang_pred, score, rejected`` for every row of ``docs``.  An empty
    table gives no rows.  Other columns are read for learning only."""
    flag = held_out_flag(F.col(key), folds, held_out).alias("held_out")
    judged = docs.select(key, flag, identifier(docs, folds=folds, held_out=held_out, key=key, text=text, **learning).judge(text).alias("judged"))
    return judged.select(key, "held_out", F.col("judged.lang").alias("lang_pred"), "judged.score", "judged.rejected")
