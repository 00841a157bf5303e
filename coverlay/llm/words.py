"""Numbers for words, computed once per distinct word while a task runs.

Texts repeat their words, so the operators compute what depends on one word for the new
words of a batch, as arrays, and look the rest up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Characters handled at once: what bounds the arrays of a batch (a longer text is one batch).
BATCH_CHARS = 1_500_000
#: Words and characters remembered; beyond them the memory starts anew, results don't change.
MEMORY_WORDS, MEMORY_CHARS = 150_000, 3_000_000


class WordTable:
    """Maps words to rows of an array: ``rows_of(words)`` gives one row per word."""

    def __init__(self, rows_of: Callable[[list], np.ndarray]):
        self._rows_of = rows_of
        self._reset()

    def _reset(self) -> None:
        self._index: dict = {}
        self._chars = 0
        self._rows: np.ndarray | None = None
        self._used = 0

    def places(self, words: Sequence) -> np.ndarray:
        """The row number of each word in ``table``, until the next call."""
        if len(self._index) > MEMORY_WORDS or self._chars > MEMORY_CHARS:
            self._reset()
        # In the order of appearance, so that retried tasks compute the same sums.
        new = [w for w in dict.fromkeys(words) if w not in self._index]
        if new or self._rows is None:
            rows = self._rows_of(new)
            if self._rows is None:
                self._rows = rows
            else:
                if self._used + len(rows) > len(self._rows):
                    grown = np.empty((2 * (self._used + len(rows)), *self._rows.shape[1:]), self._rows.dtype)
                    grown[: self._used] = self._rows[: self._used]
                    self._rows = grown
                self._rows[self._used : self._used + len(rows)] = rows
            self._index.update(zip(new, range(self._used, self._used + len(new)), strict=True))
            self._used += len(new)
            self._chars += sum(map(len, new))
        return np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))

    @property
    def table(self) -> np.ndarray:
        return self._rows

    def rows(self, words: Sequence) -> np.ndarray:
        places = self.places(words)
        return self._rows[places]


def batches(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded length together."""
    begin, chars = 0, 0
    for at, text in enumerate(texts):
        if chars and chars + len(text) > BATCH_CHARS:
            yield begin, at
            begin, chars = at, 0
        chars += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows; 0 for empty stretches."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64)
    full = lengths > 0
    if full.any():
        starts = np.cumsum(lengths) - lengths
        out[full] = np.add.reduceat(values.astype(np.float64), starts[full], axis=0)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
