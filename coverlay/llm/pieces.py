"""SentencePiece encoding and decoding with the N best segmentations of whole texts.

The lattice of a text has an edge for every vocabulary piece that matches between two
places, and an edge of byte pieces for a single character.  The score of a path is the sum
of its pieces' log probabilities.  A forward Viterbi pass gives every place the score of its
best prefix; a search from the end of the text back to its start then uses these scores as
heuristic.  They are exact, so paths leave the agenda in the order of their scores.

No piece continues over a space or a line break from the left, so a text is a chain of
segments that meet in single places of the lattice.  Viterbi passes run once per distinct
segment, over arrays.  They also give the score that a segment's second-best path loses; the
search needs only the lattices of the few segments that lose least, since a path that
deviates elsewhere is behind as many others as are asked for.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlay.llm.words import WordTable, batches, mixed

SEGMENT = re.compile(r" *[^ \n]+|\n| +")
BASE = np.uint64(0x100000001B3)
#: What an edge of byte pieces scores below the rarest piece, per byte.
BYTE_LOSS = 10.0
#: Paths that can't win: no second path.
NEVER = 1e9


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with a space for the word mark, in the order of their ids; ``scores`` are log
    probabilities.  ``byte_ids[b]`` is the piece of byte ``b``."""

    pieces: tuple[str, ...]
    scores: np.ndarray
    plain: np.ndarray
    byte_ids: np.ndarray

    @cached_property
    def direct(self) -> np.ndarray:
        """Ids that spell whole characters: pieces and the bytes below 128."""
        out = self.plain.copy()
        out[self.byte_ids[:128]] = True
        return out

    @cached_property
    def spelling(self) -> list[str]:
        out = list(self.pieces)
        for byte, i in enumerate(self.byte_ids[:128]):
            out[i] = chr(byte)
        return out


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model on the driver.

    The model has merge ranks instead of probabilities: a piece's is taken to fall with its
    rank as words' do (Zipf), one over the rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    is_byte, special = np.array([model.is_byte(i) for i in range(n)]), np.array([model.is_control(i) or model.is_unknown(i) for i in range(n)])
    plain = ~is_byte & ~special
    byte_ids = np.zeros(256, np.int64)
    for i in np.flatnonzero(is_byte):
        byte_ids[int(pieces[i][1:-1], 16)] = i
    scores = np.zeros(n)
    rank = np.cumsum(plain)
    scores[plain] = -np.log(rank[plain]) - np.log((1 / rank[plain]).sum())
    return Vocabulary(tuple(p.replace("▁", " ") for p in pieces), scores, plain, byte_ids)


class Lattice:
    """Finds edges and Viterbi scores for many segments of one length at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        ids = np.flatnonzero(vocabulary.plain)
        self.known = {vocabulary.pieces[i]: int(i) for i in ids}
        self.longest = max(map(len, self.known), default=1)
        self.byte_score = float(vocabulary.scores[ids].min(initial=0.0)) - BYTE_LOSS
        hashes = np.array([self._hash(vocabulary.pieces[i]) for i in ids], np.uint64)
        by = np.argsort(hashes)
        self._hashes, self._ids = hashes[by], ids[by]
        self._maybe = np.zeros(1 << 22, bool)
        self._maybe[(mixed(hashes) >> np.uint64(42)).astype(np.int64)] = True
        with np.errstate(over="ignore"):
            self._powers = np.cumprod(np.full(self.longest + 1, BASE, np.uint64)) if self.longest else np.zeros(0, np.uint64)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                value = value * BASE + np.uint64(ord(c) + 1)
        return value

    def _piece_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        hit = np.flatnonzero(self._maybe[(mixed(hashes) >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self._hashes, hashes[hit]), len(self._hashes) - 1)
        same = self._hashes[at] == hashes[hit]
        out[hit[same]] = self._ids[at[same]]
        return out

    def viterbi(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: best score, loss of the second-best path, number of the best
        path's ids; and all these ids, one segment after another."""
        best, loss, counts = np.zeros(len(segments)), np.full(len(segments), NEVER), np.zeros(len(segments), np.int64)
        order: list[int] = []
        stock: list[np.ndarray] = []
        groups: dict[int, list[int]] = {}
        for place, segment in enumerate(segments):
            groups.setdefault(len(segment), []).append(place)
        for length, places in groups.items():
            step = max(1, 400_000 // (length + 1))
            for begin in range(0, len(places), step):
                part = places[begin : begin + step]
                best[part], loss[part], counts[part], ids = self._viterbi([segments[p] for p in part], length)
                order += part
                stock.append(ids)
        if not stock:
            return best, loss, counts, np.zeros(0, np.int32)
        done = counts[order]
        start = np.empty(len(segments), np.int64)
        start[order] = np.cumsum(done) - done
        before = np.cumsum(counts) - counts
        return best, loss, counts, np.concatenate(stock)[np.repeat(start - before, counts) + np.arange(counts.sum())]

    def _viterbi(self, segments: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = len(segments)
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).reshape(m, length)
        width = np.ones(chars.shape, np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += chars >= limit
        prefix = np.zeros((length + 1, m), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length):
                prefix[j + 1] = prefix[j] * BASE + (chars[:, j].astype(np.uint64) + np.uint64(1))
        score = np.full((length + 1, m), -np.inf)
        score[0] = 0
        second = np.full((length + 1, m), -np.inf)
        back, piece = np.zeros((length + 1, m), np.int32), np.full((length + 1, m), -1, np.int32)
        for j in range(1, length + 1):
            low = max(0, j - self.longest)
            with np.errstate(over="ignore"):
                hashes = prefix[j][None, :] - prefix[low:j] * self._powers[j - low - 1 :: -1][: j - low, None]
            ids = self._piece_ids(hashes.ravel()).reshape(j - low, m)
            value = np.where(ids >= 0, score[low:j] + self.vocabulary.scores[ids], -np.inf)
            # A single character without a piece of its own is spelt in bytes.
            spelt = ids[-1] < 0
            value[-1] = np.where(spelt, score[j - 1] + self.byte_score * width[:, j - 1], value[-1])
            pick = value.argmax(0)
            rows = np.arange(m)
            score[j], back[j], piece[j] = value[pick, rows], low + pick, ids[pick, rows]
            if j - low > 1:
                value[pick, rows] = -np.inf
                second[j] = value.max(0)
        loss = np.full(m, NEVER)
        at = np.full(m, length)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(m)
        while (open_ := at > 0).any():
            rows_open = rows[open_]
            here = at[rows_open]
            loss[rows_open] = np.minimum(loss[rows_open], score[here, rows_open] - second[here, rows_open])
            steps.append((rows_open, piece[here, rows_open].copy()))
            spelt = piece[here, rows_open] < 0
            if spelt.any():
                steps[-1] = (rows_open, np.where(spelt, -1 - chars[rows_open, here - 1].astype(np.int64), steps[-1][1]))
            at[rows_open] = back[here, rows_open]
        owner = np.concatenate([s[0] for s in steps])[::-1]
        ids = np.concatenate([s[1].astype(np.int64) for s in steps])[::-1]
        by = np.argsort(owner, kind="stable")
        owner, ids = owner[by], ids[by]
        if (ids < 0).any():
            owner, ids = self._spell(owner, ids)
        return score[length], np.minimum(loss, NEVER), np.bincount(owner, minlength=m), ids.astype(np.int32)

    def _spell(self, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters (below 0) by the pieces of their bytes."""
        spelt = {int(c): self.vocabulary.byte_ids[list(chr(-1 - c).encode())] for c in np.unique(ids[ids < 0])}
        parts = [spelt[int(i)] if i < 0 else np.array([i]) for i in ids]
        return np.repeat(owner, [len(p) for p in parts]), np.concatenate(parts)

    def edges(self, segment: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every place the edges that end there: start, score, ids."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(segment) + 1)]
        for j in range(1, len(segment) + 1):
            for i in range(max(0, j - self.longest), j):
                known = self.known.get(segment[i:j])
                if known is not None:
                    into[j].append((i, float(self.vocabulary.scores[known]), (known,)))
                elif i == j - 1:
                    raw = segment[i].encode()
                    into[j].append((i, self.byte_score * len(raw), tuple(int(x) for x in self.vocabulary.byte_ids[list(raw)])))
        return into


def n_best(into: list[list[tuple[int, float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best paths of a lattice by A* from its end to its start.

    ``into[j]`` holds the edges that end at place ``j``.  The forward Viterbi score of a
    place is what the best rest of a path to the start scores.  A place's first ``n`` visits
    have the best ends of paths that pass it, so later ones are dropped: the agenda holds at
    most ``n`` entries per edge.
    """
    ahead = [0.0] + [-float("inf")] * (len(into) - 1)
    for j in range(1, len(into)):
        ahead[j] = max((ahead[i] + s for i, s, _ in into[j]), default=-float("inf"))
    agenda: list[tuple[float, int, int, float, tuple | None]] = [(-ahead[-1], 0, len(into) - 1, 0.0, None)]
    found: list[tuple[float, tuple[int, ...]]] = []
    count, visits = 0, [0] * len(into)
    while agenda and len(found) < n:
        _, _, place, behind, path = heapq.heappop(agenda)
        if visits[place] >= n:
            continue
        visits[place] += 1
        if place == 0:
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            found.append((behind, tuple(ids)))
            continue
        for start, score, ids_of in into[place]:
            if ahead[start] > -float("inf") and visits[start] < n:
                count += 1
                done = behind + score
                heapq.heappush(agenda, (-(ahead[start] + done), count, start, done, (ids_of, path)))
    return found


def chain(lattices: Sequence[list]) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    """One lattice of several that follow each other."""
    into: list[list[tuple[int, float, tuple[int, ...]]]] = [[]]
    for lattice in lattices:
        offset = len(into) - 1
        into += [[(i + offset, s, ids) for i, s, ids in edges] for edges in lattice[1:]]
    return into


class Encoder:
    """Encodes and decodes texts, remembering segments; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lattice = Lattice(vocabulary)
        self._segments = WordTable(self._rows)
        self._paths: list[np.ndarray] = []
        self._edges: dict[str, list] = {}
        self._byte_of = {int(i): bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}

    def _rows(self, segments: list[str]) -> np.ndarray:
        best, loss, counts, ids = self.lattice.viterbi(segments)
        out = np.empty((len(segments), 4))
        out[:, 0], out[:, 1], out[:, 2] = best, loss, counts
        # Where the path's ids lie among those of all known segments.
        if self._segments._used == 0:
            self._paths, self._length = [], 0
        out[:, 3] = self._length + np.cumsum(out[:, 2]) - out[:, 2]
        self._paths = [np.concatenate([*self._paths, ids])]
        self._length = len(self._paths[0])
        return out

    def encode(self, texts: Sequence[str], n: int = 1) -> Iterator[tuple[np.ndarray, list[float], Callable[[], list[tuple[int, ...]]]]]:
        """Of each text: the best path's ids, the scores of its ``n`` best paths, and a
        function that spells those paths out."""
        for ids, scores, spell in self.paths(texts, n):
            yield ids, scores, lambda spell=spell: [tuple(p.tolist()) for p in spell()]

    def paths(self, texts: Sequence[str], n: int = 1) -> Iterator[tuple[np.ndarray, list[float], Callable[[], list[np.ndarray]]]]:
        """As ``encode``, the paths spelt out as arrays."""
        for begin, end in batches(texts):
            split = [SEGMENT.findall(" " + t) if t else [] for t in texts[begin:end]]
            segments = [s for parts in split for s in parts]
            rows = self._segments.rows(segments) if segments else np.zeros((0, 4))
            stock = self._paths[0] if segments else np.zeros(0, np.int32)
            counts = rows[:, 2].astype(np.int64)
            before = np.cumsum(counts) - counts
            flat = stock[np.repeat(rows[:, 3].astype(np.int64) - before, counts) + np.arange(counts.sum())]
            ends = np.cumsum([len(parts) for parts in split])
            first = 0
            for parts, last in zip(split, ends, strict=True):
                mine = rows[first:last]
                base = int(before[first]) if first < len(rows) else len(flat)
                ids = flat[base : base + int(counts[first:last].sum())]
                total = float(mine[:, 0].sum())
                if n == 1 or not parts:
                    yield ids, [total][: len(parts) or 1], lambda ids=ids: [ids]
                else:
                    # Segments whose second path loses least; ties to the first.
                    weak = np.sort(np.argsort(mine[:, 1], kind="stable")[: n - 1])
                    lattice = chain([self._edges_of(parts[w]) for w in weak])
                    paths = n_best(lattice, n)
                    rest = total - float(mine[weak, 0].sum())
                    last_ids = np.cumsum(counts[first:last])
                    yield ids, [rest + s for s, _ in paths], partial(self._spelt, ids, last_ids, parts, weak, paths)
                first = last

    def _edges_of(self, segment: str) -> list:
        known = self._edges.get(segment)
        if known is None:
            if len(self._edges) > 20_000:
                self._edges.clear()
            known = self.lattice.edges(segment)
            if len(segment) < 64:
                self._edges[segment] = known
        return known

    def _spelt(self, ids: np.ndarray, ends: np.ndarray, parts: list[str], weak: np.ndarray, paths: list[tuple[float, tuple[int, ...]]]) -> list[np.ndarray]:
        """Whole paths: the best ids of all segments, those of the weak ones by each path."""
        out = []
        for _, path in paths:
            kept: list[np.ndarray] = []
            done = at = 0
            for w in weak:
                kept.append(ids[done : ends[w - 1] if w else 0])
                done, begin = int(ends[w]), at
                # Pieces of one segment spell its characters, no more and no less.
                size, spelt = len(parts[w].encode()), 0
                while spelt < size:
                    piece = path[at]
                    spelt += len(self.vocabulary.pieces[piece].encode()) if self.vocabulary.plain[piece] else 1
                    at += 1
                kept.append(np.array(path[begin:at], ids.dtype))
            out.append(np.concatenate([*kept, ids[done:]]))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return decode(self.vocabulary, ids)

    def same(self, one: np.ndarray, other: np.ndarray) -> bool:
        """Whether two paths spell the same; only what lies between their common ends is decoded."""
        n = min(len(one), len(other))
        differ = np.flatnonzero(one[:n] != other[:n])
        head = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(one[len(one) - n + head :] != other[len(other) - n + head :])
        tail = n - head - 1 - int(differ[-1]) if len(differ) else n - head
        return self._raw(one[head : len(one) - tail]) == self._raw(other[head : len(other) - tail])

    def _raw(self, ids: np.ndarray) -> bytes:
        plain, pieces = self.vocabulary.plain, self.vocabulary.pieces
        return b"".join([pieces[i].encode() if plain[i] else self._byte_of.get(i, b"") for i in ids.tolist()])


def decode(vocabulary: Vocabulary, ids: Sequence[int]) -> str:
    """The text that was encoded; ids of control pieces say nothing."""
    array = np.asarray(ids, np.int64)
    if vocabulary.direct[array].all():
        return "".join(map(vocabulary.spelling.__getitem__, array.tolist()))[1:]
    byte_of = {int(i): bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    plain, pieces = vocabulary.plain, vocabulary.pieces
    raw = b"".join([pieces[i].encode() if plain[i] else byte_of.get(i, b"") for i in array.tolist()])
    return raw.decode("utf-8", "replace")[1:]


def _joined(paths: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(paths) if paths else np.zeros(0, np.int32), pa.int32())


def _lists(lengths: Iterable[int], values: pa.Array, mask: pa.Array | None = None) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(lengths, np.int64))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, n: int = 3, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``ids`` (best path), ``others`` (the next paths, ``n`` with the
    best one), ``scores`` (of all these, best first; fewer where the text has fewer) and
    ``exact`` (decoding each of them gives the text back).

    Null texts have null results; an empty text has no ids and the score 0.  A text of any
    characters is encoded, those without a piece as bytes.  Equal scores come in any order
    that is the same in each run.  The added columns must not exist; no rows give no rows.
    """
    added = {"ids": "array<int>", "others": "array<array<int>>", "scores": "array<double>", "exact": "boolean"}
    clash = set(added) & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in parts:
            column = part.column(part.schema.get_field_index(text))
            texts = column.fill_null("").to_pylist()
            null = np.asarray(column.is_null())
            # Rows go back as soon as a few are done: ids are longer than texts.
            for begin, end in batches(texts):
                ids, others, scores, exact = [], [], [], []
                for given, (best, found, spell) in zip(texts[begin:end], encoder.paths(texts[begin:end], n), strict=True):
                    rest = [p for p in spell() if not np.array_equal(p, best)][: len(found) - 1]
                    ids.append(best)
                    others.append(rest)
                    scores.append(found)
                    exact.append(encoder.decode(best) == given and all(encoder.same(best, p) for p in rest))
                mask = pa.array(null[begin:end])
                inner = [p for rest in others for p in rest]
                columns = [
                    _lists(map(len, ids), _joined(ids), mask),
                    _lists(map(len, others), _lists(map(len, inner), _joined(inner)), mask),
                    _lists(map(len, scores), pa.array([x for found in scores for x in found], pa.float64()), mask),
                    pa.array(exact, pa.bool_(), mask=null[begin:end]),
                ]
                yield pa.RecordBatch.from_arrays([*part.slice(begin, end - begin).columns, *columns], names=names)

    names = [*docs.columns, *added]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], *[f"{name} {kind}" for name, kind in added.items()]])
    return docs.mapInArrow(encode, fields)


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the decoded text added; null ids give null."""

    def spell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{into: [None if x is None else decode(vocabulary, x) for x in part[ids]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInPandas(spell, f"{fields}, `{into}` string")

