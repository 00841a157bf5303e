"""Supervised averages of hashed word and character n-gram vectors, with a softmax on top.

A text is the mean of the vectors of its features: its words, their character n-grams and
its pairs of neighbouring words, all hashed to a fixed number of rows.  Vectors and softmax
are learned together by stochastic gradient descent.  As mean and softmax weights are
linear, a trained model keeps one number per row and class, and what a word adds to a text
is computed once per distinct word.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from coverlay.llm.words import WordTable, batches, mixed, sums

#: Lengths of character n-grams, word ends included.
GRAMS = (2, 3, 4)


def gram_hashes(words: list[str]) -> list[np.ndarray]:
    """For each word the hashes of its features: itself, then its character n-grams."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(words)
    for length, places in _by_length(words).items():
        step = max(1, 400_000 // (length + 2))
        for begin in range(0, len(places), step):
            part = places[begin : begin + step]
            table = _hashes(np.array([words[p] for p in part]), length)
            for p, row in zip(part, table, strict=True):
                out[p] = row
    return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        groups.setdefault(len(word), []).append(place)
    return groups


def _hashes(words: np.ndarray, length: int) -> np.ndarray:
    """One row of feature hashes per word; all words have ``length`` characters."""
    chars = np.frombuffer("".join(words.tolist()).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    marked = np.empty((len(words), length + 2), np.uint64)
    marked[:, 0], marked[:, -1] = 2, 3
    marked[:, 1:-1] = chars
    with np.errstate(over="ignore"):
        whole = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
        for column in range(length + 2):
            whole = (whole ^ marked[:, column]) * np.uint64(0x100000001B3)
        parts = [mixed(whole)[:, None]]
        for n in GRAMS:
            if length + 2 < n:
                continue
            width = length + 3 - n
            gram = np.full((len(words), width), n, np.uint64)
            for offset in range(n):
                gram = (gram ^ marked[:, offset : offset + width]) * np.uint64(0x9E3779B97F4A7C15)
                gram ^= gram >> np.uint64(29)
            parts.append(mixed(gram))
    return np.concatenate(parts, axis=1)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of neighbouring words; a word that repeats itself is one feature, whatever it is."""
    with np.errstate(over="ignore"):
        pair = mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)
    return np.where(first == second, np.uint64(1), pair)


@dataclass(frozen=True)
class Model:
    """``weights``: a row per hash bucket and a column per class; ``bias``: per class."""

    classes: tuple
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Applies a model to texts, remembering words; one per task."""

    def __init__(self, model: Model):
        self.model = model
        self._words = WordTable(self._word_rows)

    def _word_rows(self, words: list[str]) -> np.ndarray:
        """Per word: sum of its features' weights by class, number of features, own hash."""
        weights, buckets = self.model.weights, np.uint64(len(self.model.weights))
        out = np.zeros((len(words), weights.shape[1] + 2))
        for length, places in _by_length(words).items():
            step = max(1, 400_000 // (length + 2))
            for begin in range(0, len(places), step):
                part = places[begin : begin + step]
                hashes = _hashes(np.array([words[p] for p in part]), length)
                rows = (hashes % buckets).astype(np.int64)
                for c in range(weights.shape[1]):
                    out[part, c] = weights[:, c][rows].sum(1)
                out[part, -2] = hashes.shape[1]
                out[part, -1] = (hashes[:, 0] >> np.uint64(12)).astype(np.float64)
        return out

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        """One row per text; a text without words gets the bias."""
        out = np.empty((len(texts), len(self.model.classes)))
        weights, buckets = self.model.weights, np.uint64(len(self.model.weights))
        for begin, end in batches(texts):
            split = [t.split() for t in texts[begin:end]]
            lengths = np.array([len(s) for s in split])
            words = [w for s in split for w in s]
            total, features = np.zeros((end - begin, len(self.model.classes))), np.zeros(end - begin)
            if words:
                places = self._words.places(words)
                table = self._words.table
                total = sums(table[:, :-2][places], lengths)
                features = sums(table[:, -2][places], lengths)
                own = table[:, -1][places].astype(np.uint64)
                pairs = (_pair_hashes(own[:-1], own[1:]) % buckets).astype(np.int64)
                inside = np.ones(len(words), bool)
                inside[np.cumsum(lengths)[lengths > 0] - 1] = False
                gains = np.zeros((len(words), total.shape[1]))
                for c in range(total.shape[1]):
                    gains[:-1, c] = weights[:, c][pairs]
                gains[~inside] = 0
                total += sums(gains, lengths)
                features += np.maximum(lengths - 1, 0)
            out[begin:end] = total / np.maximum(features, 1)[:, None] + self.model.bias
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(text: str, seen: dict[str, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's features and their share of its features."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    new = [w for w in dict.fromkeys(words) if w not in seen]
    seen.update(zip(new, gram_hashes(new), strict=True))
    own = np.array([seen[w][0] for w in words], np.uint64) >> np.uint64(12)
    hashes = np.concatenate([*(seen[w] for w in words), _pair_hashes(own[:-1], own[1:])])
    rows, counts = np.unique((hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
    return rows, counts / len(hashes)


def fit(texts: Sequence[str], labels: Sequence, buckets: int = 1 << 17, dim: int = 8, epochs: int = 12, rate: float = 0.6, batch: int = 16, seed: int = 0) -> Model:
    """Learn from labelled texts by stochastic gradient descent with a falling rate.

    Classes are the sorted distinct labels.  Each text counts once; texts without words
    teach the bias only.  No texts: a ``ValueError``, as there are no classes.
    """
    classes = tuple(sorted(set(labels)))
    if not classes:
        raise ValueError("no labelled rows to learn from")
    index = {c: i for i, c in enumerate(classes)}
    wanted = np.array([index[c] for c in labels])
    seen: dict[str, np.ndarray] = {}
    data = []
    for text in texts:
        if len(seen) > 200_000:
            seen.clear()
        data.append(_features(text, seen, buckets))
    rng = np.random.default_rng(seed)
    vectors = (rng.random((buckets, dim), np.float32) - 0.5) / dim
    top, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes))
    steps, step = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), batch):
            part = order[begin : begin + batch]
            now = rate * (1 - step / steps)
            step += 1
            rows = np.concatenate([data[p][0] for p in part])
            share = np.concatenate([data[p][1] for p in part]).astype(np.float32)
            lengths = np.array([len(data[p][0]) for p in part])
            means = sums(vectors[rows] * share[:, None], lengths)
            error = softmax(means @ top + bias)
            error[np.arange(len(part)), wanted[part]] -= 1
            down = (error @ top.T).astype(np.float32)
            top -= now * (means.T @ error).astype(np.float32)
            bias -= 0.1 * now * error.mean(0)
            np.add.at(vectors, rows, -now * 50 * share[:, None] * np.repeat(down, lengths, axis=0))
    return Model(classes, (vectors @ top).astype(np.float64), bias)
