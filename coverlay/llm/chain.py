"""Linear-chain conditional random field over two tags, for many texts at once.

A tag sequence scores the sum of its tokens' emissions (for tag 1; tag 0 has none) and its
transitions.  With two tags the forward recursion is a map of one ratio, and such maps
compose, so the tokens of all texts are cut into equal stretches that advance in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Emissions are held within this, so that ratios stay finite.
LIMIT = 30.0


@dataclass
class Links:
    """Log weights: ``move[a, b]`` between neighbouring tags, ``first`` of tag 1 at a start."""

    move: np.ndarray
    first: float


def _scan(maps: np.ndarray) -> np.ndarray:
    """States after each of a sequence of 2x2 maps, from an even state: a row vector times
    the maps so far, scaled to sum 1.  ``maps``: ``n, 2, 2``, non-negative."""
    n = len(maps)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    padded = np.tile(np.eye(2), (rows * width, 1, 1))
    padded[:n] = maps
    m = np.ascontiguousarray(padded.reshape(rows, width, 2, 2).transpose(1, 2, 3, 0))
    whole = np.repeat(np.eye(2)[:, :, None], rows, axis=2)
    for step in range(width):
        m00, m01, m10, m11 = m[step, 0, 0], m[step, 0, 1], m[step, 1, 0], m[step, 1, 1]
        whole = np.stack([np.stack([whole[0, 0] * m00 + whole[0, 1] * m10, whole[0, 0] * m01 + whole[0, 1] * m11]), np.stack([whole[1, 0] * m00 + whole[1, 1] * m10, whole[1, 0] * m01 + whole[1, 1] * m11])])
        whole /= whole.sum(axis=(0, 1))
    state = np.array([0.5, 0.5])
    entering = np.empty((2, rows))
    for row in range(rows):
        entering[:, row] = state
        state = state @ whole[:, :, row]
        state /= state.sum()
    out = np.empty((width, 2, rows))
    a, b = entering
    for step in range(width):
        a, b = a * m[step, 0, 0] + b * m[step, 1, 0], a * m[step, 0, 1] + b * m[step, 1, 1]
        total = a + b
        a, b = a / total, b / total
        out[step, 0], out[step, 1] = a, b
    return out.transpose(2, 0, 1).reshape(rows * width, 2)[:n]


def _maps(emission: np.ndarray, start: np.ndarray, links: Links) -> np.ndarray:
    e = np.exp(np.clip(emission, -LIMIT, LIMIT))
    maps = np.empty((len(e), 2, 2))
    maps[:, :, 0] = np.where(start[:, None], 1.0, np.exp(links.move[:, 0])[None, :])
    maps[:, :, 1] = np.where(start[:, None], np.exp(links.first), np.exp(links.move[:, 1])[None, :]) * e[:, None]
    return maps


def marginals(emission: np.ndarray, start: np.ndarray, links: Links) -> np.ndarray:
    """Probability of tag 1 per token; ``start`` marks each text's first token."""
    if not len(emission):
        return np.zeros(0)
    maps = _maps(emission, start, links)
    forward = _scan(maps)
    backward = _backward(maps)
    both = forward * backward
    return both[:, 1] / both.sum(1)


def _backward(maps: np.ndarray) -> np.ndarray:
    """Weight of what follows each token, by its tag, scaled."""
    after = _scan(maps[:0:-1].transpose(0, 2, 1)) if len(maps) > 1 else np.zeros((0, 2))
    return np.concatenate([after[::-1], [[0.5, 0.5]]])


def gradient(emission: np.ndarray, start: np.ndarray, links: Links, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log likelihood of ``tags``: by emission, transition and start weight."""
    maps = _maps(emission, start, links)
    forward, backward = _scan(maps), _backward(maps)
    both = forward * backward
    one = both[:, 1] / both.sum(1)
    # Pairs of neighbours within a text.
    at = np.flatnonzero(~start[1:]) + 1
    pair = forward[at - 1][:, :, None] * maps[at] * backward[at][:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[at - 1], tags[at]), 1)
    return tags - one, seen - pair.sum(0), float((tags[start] - one[start]).sum())
