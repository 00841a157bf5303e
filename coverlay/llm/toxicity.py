"""Toxic spans by a linear-chain conditional random field.

Learning: tokens are labelled from documents' labels, a token of a toxic document being
toxic if its word occurs in far more toxic than clean documents.  A chain over hashed word
features learns those tags by stochastic gradient ascent on their likelihood.

Scoring: forward-backward gives every token's marginal.  A document's score is a logistic
of the largest marginal and of the sum of all, fitted on the sample; tokens with a marginal
of one half or more are the offending spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlay.llm.chain import Links, gradient, marginals
from coverlay.llm.columns import fold_of
from coverlay.llm.samples import held_out_flag, labelled_texts
from coverlay.llm.words import WordTable, batches, mixed, sums

EDGES = re.compile(r"^\W+|\W+$")
TOKEN = re.compile(r"\S+")
BUCKETS = 1 << 16
#: A word is toxic if the share of toxic documents that hold it is so many times that of clean
#: ones, and the difference has this log likelihood ratio at least (one word in 10,000 by chance).
LEAST_RATIO, LEAST_EVIDENCE = 4.0, 15.0


def plain(word: str) -> str:
    """Lower case without marks at the ends."""
    return word.lower() if word.isalpha() else EDGES.sub("", word.lower())


def _buckets(words: list[str]) -> np.ndarray:
    """Features of a word: itself, its stems, its last three characters, its make-up."""
    hashes: list[int] = []
    for word in words:
        bare = plain(word)
        raw = bare.encode()
        make = bytes((bare.isalpha(), bare.isdigit(), word.isupper(), len(bare) != len(word), min(len(bare), 12)))
        hashes += (crc32(raw), crc32(bare[:4].encode(), 1), crc32(bare[:5].encode(), 2), crc32(bare[-3:].encode(), 3), crc32(make, 4))
    return (mixed(np.array(hashes, np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(len(words), 5)


def forms(word: str) -> tuple[str, ...]:
    """A word and, for longer ones, its stems of four to six characters, marked by a star."""
    bare = plain(word)
    return bare, *(bare[:n] + "*" for n in (4, 5, 6) if len(bare) > n)


@dataclass(frozen=True)
class Tagger:
    """Feature weights, transitions, and the logistic from marginals to a score."""

    weights: np.ndarray
    bias: float
    links: Links
    logistic: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, 1))
        return (self.weights[_buckets(words)].sum(1) + self.bias)[:, None]


def _tokens(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    split = [t.split() for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    words = [w for s in split for w in s]
    start = np.zeros(len(words), bool)
    start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return words, lengths, start


def copy_groups(texts: Sequence[str]) -> list[int]:
    """A group number per text: texts that share two of eight minima of their hashed
    three-word runs are copies of one another."""
    up = list(range(len(texts)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    known: dict[tuple[int, int], int] = {}
    for i, text in enumerate(texts):
        words = text.split()
        runs = np.array([crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))], np.uint64)
        hits = Counter(known.setdefault((p, int(mixed(runs + np.uint64(p << 40)).min())), i) for p in range(8))
        for other, n in hits.items():
            if n >= 2 and other != i:
                up[root(i)] = root(other)
    return [root(i) for i in range(len(texts))]


def toxic_words(texts: Sequence[str], toxic: Sequence[int]) -> set[str]:
    """Words and stems that tell toxic from clean texts; a group of copies counts once for
    each label."""
    together: dict[tuple[int, int], set[str]] = {}
    for text, label, group in zip(texts, toxic, copy_groups(texts), strict=True):
        together.setdefault((label, group), set()).update(f for word in set(text.split()) for f in forms(word))
    counts = {0: Counter(), 1: Counter()}
    total = Counter(label for label, _ in together)
    for (label, _), words in together.items():
        counts[label].update(words)
    found = set()
    for word, n in counts[1].items():
        clean = counts[0][word]
        if word and n * (total[0] + 1) >= LEAST_RATIO * clean * (total[1] + 1) and _ratio(n, total[1], clean, total[0]) >= LEAST_EVIDENCE:
            found.add(word)
    return found


def _ratio(a: int, all_a: int, b: int, all_b: int) -> float:
    """Log likelihood ratio of two shares against one."""
    cells = ((a, all_a, a + b), (all_a - a, all_a, all_a + all_b - a - b), (b, all_b, a + b), (all_b - b, all_b, all_a + all_b - a - b))
    return 2 * sum(x * math.log(x * (all_a + all_b) / (row * column)) for x, row, column in cells if x)


def _evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: 1, log odds of its largest marginal, log of the sum of its marginals."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    top = np.full(len(lengths), 1e-9)
    full = lengths > 0
    if full.any():
        top[full] = np.maximum.reduceat(p, (np.cumsum(lengths) - lengths)[full])
    total = np.maximum(sums(p[:, None], lengths)[:, 0], 1e-9)
    return np.stack([np.ones(len(lengths)), np.log(top / (1 - top)), np.log(total)], axis=1)


def fit(texts: Sequence[str], toxic: Sequence[int], weigh: dict[int, float] | None = None, epochs: int = 6, rate: float = 0.5, batch_docs: int = 16, decay: float = 1e-4, seed: int = 0) -> Tagger:
    """Learn from whole labelled texts.  Without toxic examples every score is low.

    ``weigh``: how many labelled rows a sampled text of a label stands for.
    """
    marked = toxic_words(texts, toxic)
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(BUCKETS), -4.0
    links = Links(np.zeros((2, 2)), -1.0)
    power, power_move = np.full(BUCKETS, 1e-2), np.full((2, 2), 1e-2)
    table = WordTable(_buckets)
    cues = WordTable(lambda words: np.array([[not marked.isdisjoint(forms(w))] for w in words], bool).reshape(len(words), 1))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), batch_docs):
            part = order[begin : begin + batch_docs]
            words, lengths, start = _tokens([texts[p] for p in part])
            if not words:
                continue
            is_toxic = np.repeat(np.array([toxic[p] for p in part]), lengths)
            tags = (is_toxic & cues.rows(words)[:, 0]).astype(np.int64)
            rows = table.rows(words)
            by_token, by_move, by_first = gradient(weights[rows].sum(1) + bias, start, links, tags)
            step = np.zeros(BUCKETS)
            np.add.at(step, rows.ravel(), np.repeat(by_token, rows.shape[1]))
            step -= decay * weights
            power += step**2
            weights += rate * step / np.sqrt(power)
            power_move += by_move**2
            links = Links(links.move + 0.1 * by_move / np.sqrt(power_move), links.first + 0.1 * np.sign(by_first) * min(abs(by_first) / len(part), 1))
            bias += 0.1 * float(np.clip(by_token.sum() / len(part), -1, 1))
    tagger = Tagger(weights, bias, links, np.zeros(3))
    found = np.concatenate([evidence for evidence, _, _ in Spotter(tagger).evidence(texts)]) if len(texts) else np.zeros((0, 3))
    return Tagger(weights, bias, links, _logistic(found, np.array(toxic, float), np.array([(weigh or {}).get(y, 1.0) for y in toxic])))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; one in a hundred where nothing tells the classes."""
    if not y.any():
        return np.array([-math.log(99), 0.0, 0.0])
    scale = np.array([1.0, 10.0, 10.0])
    x, w = x / scale, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-2 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w = w + np.linalg.solve(hess, grad)
    return w / scale


class Spotter:
    """Applies a tagger to texts, remembering words; one per task."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self._words = WordTable(tagger.emissions)

    def evidence(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for begin, end in batches(texts):
            words, lengths, start = _tokens(texts[begin:end])
            emission = self._words.rows(words)[:, 0] if words else np.zeros(0)
            p = marginals(emission, start, self.tagger.links)
            yield _evidence(p, lengths), p, lengths

    def judge(self, texts: Sequence[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """Score and offending character spans of each text."""
        scores, spans, at = [], [], 0
        for evidence, p, lengths in self.evidence(texts):
            scores.append(1 / (1 + np.exp(-np.clip(evidence @ self.tagger.logistic, -700, 700))))
            begin = 0
            for n in lengths:
                hot = np.flatnonzero(p[begin : begin + n] >= 0.5)
                spans.append(_spans(texts[at], hot) if len(hot) else [])
                begin += n
                at += 1
        return (np.concatenate(scores) if scores else np.zeros(0)), spans


def _spans(text: str, hot: np.ndarray) -> list[dict]:
    """Offsets of runs of offending tokens."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    out: list[dict] = []
    last = -2
    for i in hot:
        if i == last + 1:
            out[-1]["end"] = tokens[i][1]
        else:
            out.append({"begin": tokens[i][0], "end": tokens[i][1]})
        last = i
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 400, folds: int = 5, held_out: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted, spans`` for every row of ``docs``.

    Learns from at most ``per_class`` labelled texts of each class outside the held-out
    fold.  Null and empty texts have no tokens: their score is that of no evidence and they
    have no spans.  Equal texts score alike; long texts are read whole; rows without a label
    are scored too.  An empty table gives no rows, and labels that are missing altogether
    give low scores.  ``spans`` holds character offsets, ends exclusive.
    """
    sample = labelled_texts(docs, labels, label, per_class, folds, held_out, key, text)
    # How many labelled rows there are of each class, for the score's base rate.
    learned = labels.filter(F.col(key).isNotNull() & (fold_of(F.col(key), folds) != held_out))
    counts = learned.agg(*(F.count(F.when(F.col(label) == y, 1)).alias(f"n{y}") for y in (0, 1))).first()
    taken = Counter(int(y) for _, y in sample)
    weigh = {y: counts[f"n{y}"] / n for y, n in taken.items()}
    tagger = fit([t for t, _ in sample], [int(y) for _, y in sample], weigh)
    key_type = docs.schema[key].dataType.simpleString()

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spotter = Spotter(tagger)
        for part in parts:
            scores, spans = spotter.judge(part["text"].fillna("").tolist())
            yield pd.DataFrame({"key": part["key"], "held_out": part["held_out"], "score": scores, "spans": spans})

    picked = docs.select(F.col(key).alias("key"), held_out_flag(F.col(key), folds, held_out).alias("held_out"), F.col(text).alias("text"))
    scored = picked.mapInPandas(score, f"key {key_type}, held_out boolean, score double, spans array<struct<begin:int,end:int>>")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
