"""Embedding near-duplicates through small-world graphs, one per shard of a label.

1. Equal vectors of a label become one row with a count.
2. The rows of a label are dealt to shards of bounded size; each shard gets a hierarchical
   navigable small-world graph, built once, in waves: a wave searches the graph so far, links to
   its nearest nodes there and within the wave, and prunes by the usual diversity rule.
3. Blocks of query rows visit every shard of their label.  The beam is widened until an
   audit of queries, held against all rows of the shard, finds what it should, and for each
   query until the beam reaches past the threshold.
4. Hits are confirmed by the cosine in double precision; each block returns link counts and
   a forest of its links, whose components are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlay.llm.components import components
from coverlay.llm.forest import Forest
from coverlay.operators.lineage import settle

#: Rows of a shard and of a query block, about.
SHARD_ROWS, BLOCK_ROWS = 8_192, 8_192
#: Links of a node per layer (twice as many on the ground), beam while building.
DEGREE, BUILD_BEAM = 12, 48
#: Queries audited per block, and the share of true links that the beam must find.
AUDITED, RECALL = 256, 0.999
#: What single precision may take from a cosine.
SLACK = 1e-5


class Graph:
    """Layers of neighbour tables over unit vectors; ``-1`` fills free places."""

    def __init__(self, unit: np.ndarray, seed: int = 0, links: np.ndarray | None = None):
        self.unit = unit.astype(np.float32)
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(DEGREE)).astype(np.int64)
        # Higher nodes first: every wave finds its entry points in the graph so far.
        self.order = np.argsort(-level, kind="stable")
        self.level = level
        widths = [2 * DEGREE] + [DEGREE] * int(level.max(initial=0))
        if links is not None:
            # Built before: the layers lie side by side.
            self.layers = np.split(links.reshape(n, -1), np.cumsum(widths)[:-1], axis=1)
        else:
            self.layers = [np.full((n, width), -1, np.int32) for width in widths]
            self._build()

    def _build(self) -> None:
        n, done = len(self.unit), 0
        while done < n:
            # Waves double, as long as a layer's newcomers are fewer than its nodes.
            wave = self.order[done : done + min(max(done, 32), 1024)]
            for depth in range(len(self.layers)):
                joining = wave[self.level[wave] >= depth]
                if not len(joining):
                    continue
                near = [self._all_pairs(joining, joining)]
                present = self.order[:done]
                present = present[self.level[present] >= depth]
                if len(present):
                    found = self.search(self.unit[joining], BUILD_BEAM, stop=depth) if len(present) > 4 * BUILD_BEAM else self._all_pairs(joining, present)
                    near.append(found)
                self._link(depth, joining, np.concatenate(near, axis=1))
            done += len(wave)

    def _all_pairs(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        score = self.unit[rows] @ self.unit[others].T
        score[rows[:, None] == others[None, :]] = -2
        take = min(BUILD_BEAM, len(others))
        best = np.argpartition(-score, take - 1, axis=1)[:, :take]
        found = others[best].astype(np.int32)
        found[found == rows[:, None]] = -1
        return found

    def _scores(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        score = np.einsum("id,ijd->ij", self.unit[rows], self.unit[others])
        score[others < 0] = -2
        return score

    def _link(self, depth: int, rows: np.ndarray, near: np.ndarray) -> None:
        table = self.layers[depth]
        table[rows] = self._diverse(rows, near, table.shape[1])
        # Links back: each node keeps a diverse choice of its old and new neighbours.
        ends = np.repeat(rows, table.shape[1])
        targets = table[rows].ravel()
        ends, targets = ends[targets >= 0], targets[targets >= 0]
        if not len(targets):
            return
        by = np.argsort(targets, kind="stable")
        ends, targets = ends[by], targets[by]
        nodes, first, count = np.unique(targets, return_index=True, return_counts=True)
        most = int(min(count.max(), 4 * table.shape[1]))
        back = np.full((len(nodes), most), -1, np.int32)
        place = np.arange(len(targets)) - np.repeat(first, count)
        fits = place < most
        back[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = ends[fits]
        table[nodes] = self._diverse(nodes, np.concatenate([table[nodes], back], axis=1), table.shape[1])

    def _diverse(self, rows: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
        """The nearest candidates that are nearer to the row than to one already chosen;
        free places are filled with the nearest of the others."""
        out = np.full((len(rows), keep), -1, np.int32)
        for begin in range(0, len(rows), 512):
            part, cand = rows[begin : begin + 512], np.sort(near[begin : begin + 512], axis=1)
            cand = cand.copy()
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            cand[cand == part[:, None]] = -1
            score = self._scores(part, cand)
            by = np.argsort(-score, axis=1, kind="stable")[:, : 3 * keep]
            cand, score = np.take_along_axis(cand, by, 1), np.take_along_axis(score, by, 1)
            mutual = np.einsum("ijd,ikd->ijk", self.unit[cand], self.unit[cand])
            chosen = np.zeros(cand.shape, bool)
            for j in range(cand.shape[1]):
                shadowed = (chosen[:, :j] & (mutual[:, j, :j] > score[:, j, None])).any(1)
                chosen[:, j] = (cand[:, j] >= 0) & ~shadowed
            rank = np.where(cand < 0, 2, np.where(chosen, 0, 1))
            first = np.argsort(rank, axis=1, kind="stable")[:, :keep]
            out[begin : begin + 512, : first.shape[1]] = np.take_along_axis(cand, first, 1)
        return out

    def search(self, queries: np.ndarray, beam: int, stop: int = 0) -> np.ndarray:
        """Rows of the ``beam`` best nodes found per query, best first, ``-1`` where fewer."""
        queries = queries.astype(np.float32)
        entry = np.full((len(queries), 1), self.order[0], np.int32)
        for depth in range(len(self.layers) - 1, stop, -1):
            entry = self._beam(queries, entry, 1, self.layers[depth])
        return self._beam(queries, entry, beam, self.layers[stop])

    def _beam(self, queries: np.ndarray, entry: np.ndarray, beam: int, table: np.ndarray) -> np.ndarray:
        out = np.full((len(queries), beam), -1, np.int32)
        for begin in range(0, len(queries), 1024):
            out[begin : begin + 1024] = self._beam_block(queries[begin : begin + 1024], entry[begin : begin + 1024], beam, table)
        return out

    def _beam_block(self, q: np.ndarray, entry: np.ndarray, beam: int, table: np.ndarray) -> np.ndarray:
        """All queries step together: each expands its best unexpanded node, until none is
        left in its beam."""
        m, n = len(q), len(self.unit)
        ids = np.full((m, beam), -1, np.int32)
        score = np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)
        start = entry[:, 0]
        ids[:, 0], score[:, 0], open_[:, 0] = start, np.einsum("id,id->i", q, self.unit[start]), True
        seen[rows, start] = True
        active = rows
        while len(active):
            ranked = np.where(open_[active], score[active], -np.inf)
            pick = ranked.argmax(1)
            going = ranked[np.arange(len(active)), pick] > -np.inf
            active, pick = active[going], pick[going]
            if not len(active):
                break
            open_[active, pick] = False
            next_ = table[ids[active, pick]]
            fresh = (next_ >= 0) & ~seen[active[:, None], next_]
            some = fresh.any(1)
            if not some.any():
                continue
            hot, next_, fresh = active[some], next_[some], fresh[some]
            at, where = np.nonzero(fresh)
            seen[hot[at], next_[at, where]] = True
            gain = np.full(next_.shape, -np.inf, np.float32)
            gain[at, where] = np.einsum("id,id->i", q[hot[at]], self.unit[next_[at, where]])
            all_ids = np.concatenate([ids[hot], next_], 1)
            all_score = np.concatenate([score[hot], gain], 1)
            all_open = np.concatenate([open_[hot], fresh], 1)
            best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            ids[hot] = np.take_along_axis(all_ids, best, 1)
            score[hot] = np.take_along_axis(all_score, best, 1)
            open_[hot] = np.take_along_axis(all_open, best, 1)
        by = np.argsort(-score, axis=1, kind="stable")
        return np.where(np.take_along_axis(score, by, 1) > -np.inf, np.take_along_axis(ids, by, 1), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; vectors of any finite, non-zero size."""
    return np.einsum("id,id->i", a, b) / (np.sqrt(np.einsum("id,id->i", a, a)) * np.sqrt(np.einsum("id,id->i", b, b)))


def find_links(graph: Graph, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """``query row, shard row, recall`` in portions: the pairs found with ``cosine >=
    threshold``, and the share of true links that the last audit found, over all its queries.

    Rows are double vectors; ``own`` is each query's own row in the shard or -1, no pair.
    An audited query with more true links than half a beam has to show more hits than that,
    or all of them; else the beam is widened for all.
    A beam of all rows is exact, which ends both kinds of widening.
    """
    n = len(rows)
    unit = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    truth = unit[audited] @ graph.unit.T >= threshold - SLACK
    inside = own[audited] >= 0
    truth[np.flatnonzero(inside), own[audited][inside]] = False
    beam = min(beam, n)
    while True:
        hit, blind = _audit(graph, unit[audited], own[audited], truth, threshold, beam)
        want = truth.sum()
        recall = float(hit.sum() / want) if want else 1.0
        if (recall >= RECALL and not blind) or beam >= n:
            break
        beam = 2 * beam if 16 * beam < n else n
    pending = np.arange(len(queries))
    while len(pending):
        again = []
        for begin in range(0, len(pending), 512):
            part = pending[begin : begin + 512]
            if beam < n:
                found, near, wider = _look(graph, unit[part], own[part], threshold, beam)
                again.append(part[wider])
                at, where = np.nonzero(near & ~wider[:, None])
                where = found[at, where]
            else:
                at, where = np.nonzero(unit[part] @ graph.unit.T >= threshold - SLACK)
            for cut in range(0, len(at), 65_536):
                a, b = part[at[cut : cut + 65_536]], where[cut : cut + 65_536]
                real = (own[a] != b) & (cosine(queries[a], rows[b]) >= threshold)
                yield a[real], b[real], recall
        pending = np.concatenate(again) if again else pending[:0]
        beam = _wider(beam, n)


def _wider(beam: int, n: int) -> int:
    return 4 * beam if 16 * beam < n else n


def _look(graph: Graph, unit: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows found, which of them reach the threshold, and the queries that need a wider beam:
    those with hits in more than half of it, as what lies past the threshold is not seen, and
    those that did not come upon their own row."""
    found = graph.search(unit, beam)
    near = np.where(found >= 0, np.einsum("id,ijd->ij", unit, graph.unit[found]), -2) >= threshold - SLACK
    lost = (own >= 0) & ~(found == own[:, None]).any(1)
    return found, near, (near.sum(1) > beam // 2) | lost


def _audit(graph: Graph, unit: np.ndarray, own: np.ndarray, truth: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, bool]:
    """The true links that queries find in the end, widened as they will be, and whether one
    with more of them than half a beam went unnoticed and was not widened."""
    n, hit, blind = len(graph.unit), np.zeros_like(truth), False
    pending = np.arange(len(unit))
    while len(pending):
        if beam >= n:
            hit[pending] = truth[pending]
            break
        found, near, wider = _look(graph, unit[pending], own[pending], threshold, beam)
        at, where = np.nonzero(near & ~wider[:, None])
        hit[pending[at], found[at, where]] = True
        done = pending[~wider]
        hit[done] &= truth[done]
        many = truth[done].sum(1)
        blind |= bool(((many > beam // 2) & (hit[done].sum(1) < many)).any())
        pending = pending[wider]
        beam = _wider(beam, n)
    return hit, blind


def _scaled(vectors: pd.Series) -> np.ndarray:
    """One matrix, each row's largest component 1, so that squares can't overflow."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("id", ignore_index=True)
    rows = _scaled(shard["v"])
    first = shard.iloc[0]
    ids, copies = (shard[c].to_numpy(np.int64) for c in ("id", "copies"))
    graph = Graph(rows / np.linalg.norm(rows, axis=1, keepdims=True), seed=int(first["shard"]))
    head = {"g": first["g"], "dims": first["dims"], "shard": first["shard"], "blocks": first["blocks"]}
    body = {"ids": ids.tobytes(), "copies": copies.tobytes(), "rows": rows.tobytes()}
    return pd.DataFrame([head | body | {"links": np.concatenate(graph.layers, axis=1).tobytes()}])


def _visit(threshold: float):
    def visit(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = np.zeros(0, np.int64)
        if queries.empty or shard.empty:
            return _found(empty, empty, empty, empty, 1.0)
        built = shard.iloc[0]
        s_ids, copies = (np.frombuffer(built[c], np.int64) for c in ("ids", "copies"))
        rows = np.frombuffer(built["rows"], np.float64).reshape(len(s_ids), -1)
        graph = Graph(rows / np.linalg.norm(rows, axis=1, keepdims=True), seed=int(built["shard"]), links=np.frombuffer(built["links"], np.int32))
        q_ids = queries["id"].to_numpy(np.int64)
        place = np.minimum(np.searchsorted(s_ids, q_ids), len(s_ids) - 1)
        own = np.where(s_ids[place] == q_ids, place, -1)
        forest, links, recall = Forest(np.concatenate([q_ids, s_ids])), np.zeros(len(q_ids), np.int64), 1.0
        for a, b, recall in find_links(graph, rows, _scaled(queries["v"]), own, threshold):
            links += np.bincount(a, weights=copies[b], minlength=len(q_ids)).astype(np.int64)
            forest.join(q_ids[a], s_ids[b])
        return _found(q_ids, links, *forest.edges(), recall)

    return visit


def _found(ids: np.ndarray, links: np.ndarray, child: np.ndarray, parent: np.ndarray, recall: float) -> pd.DataFrame:
    counts = pd.DataFrame({"id": ids, "links": links, "other": pd.array([pd.NA] * len(ids), dtype="Int64"), "recall": recall})
    tree = pd.DataFrame({"id": child, "links": np.zeros(len(child), np.int64), "other": pd.array(parent, dtype="Int64"), "recall": recall})
    return pd.concat([counts, tree], ignore_index=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """``key, n_links, component_id, kept, recall``, one row per input row.

    Rows of equal, non-null label (all rows, if ``label`` is None) and equal length are
    compared.  ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest key reachable by links, ``kept`` marks one row that has it, ``recall`` is the
    smallest share of links that audits of the row's blocks found.  Vectors that are null,
    empty, zero or hold a null, NaN or infinite component link with nothing (``recall`` null).
    Equal vectors always link if their cosine with themselves reaches the threshold, as it
    does up to 1.  Rows are told apart by themselves, not by key: rows of one key link as
    others do, and rows with a null key too, whose ``component_id`` is null if no row that
    they reach has a key.  Keys are integers; an empty table gives no rows; other columns are
    not read.
    """
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0)
    group = F.lit(0) if label is None else F.col(label)
    named = vectors.select(F.col(key).alias("id"), group.alias("g"), F.transform(x, lambda v: v.cast("double") + 0.0).alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    usable = F.col("sound") & F.col("g").isNotNull()
    member = named.filter(usable).select("id", "g", "v")
    # Nodes are numbers of their own, as keys may be null or repeated.
    equal = member.groupBy("g", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    distinct = settle(equal.sortWithinPartitions("rep", "v").withColumn("node", F.monotonically_increasing_id()))
    sized = distinct.withColumn("dims", F.size("v"))
    counts = sized.groupBy("g", "dims").agg(F.count("*").alias("n"))
    cut = counts.select("g", "dims", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = sized.join(cut, ["g", "dims"]).select("g", "dims", "shards", "blocks", F.col("node").alias("id"), "copies", "v")
    g_type = distinct.schema["g"].dataType.simpleString()
    graphs = settle(
        dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "v"), "shards").cast("int"))
        .groupBy("g", "dims", "shard")
        .applyInPandas(_build, f"g {g_type}, dims int, shard int, blocks int, ids binary, copies binary, rows binary, links binary")
    )
    shard = graphs.select("g", "dims", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "ids", "copies", "rows", "links")
    asked = dealt.select("g", "dims", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64(F.lit(2), "v"), "blocks").cast("int").alias("block"), "id", "v")
    place = ["g", "dims", "shard", "block"]
    found = settle(asked.groupBy(*place).cogroup(shard.groupBy(*place)).applyInPandas(_visit(threshold), "id long, links long, other long, recall double"))
    linked = components(found.filter(F.col("other").isNotNull()).select(F.col("id").alias("a"), F.col("other").alias("b")))
    per_node = found.groupBy("id").agg(F.sum("links").alias("links"), F.min("recall").alias("recall"))
    # The head of a component is its node with the smallest key, nulls last.
    reps = distinct.select("node", F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("key"), F.col("node").alias("node")).alias("rep"))
    heads = linked.join(reps, "node").groupBy("component").agg(F.min("rep").alias("head"))
    headed = linked.join(heads, "component").select("node", "head")
    judged = (
        distinct.join(per_node.withColumnRenamed("id", "node"), "node", "left").join(headed, "node", "left")
        .select("g", "v", "node", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce(F.col("head.node"), "node").alias("head"), F.when(F.col("head").isNull(), F.col("rep")).otherwise(F.col("head.key")).alias("component"), "recall")
    )
    first = (F.col("node") == F.col("head")) & F.col("id").eqNullSafe(F.col("rep"))
    own = member.join(judged, ["g", "v"]).select("id", "node", "links", "component", "recall", first.alias("first"))
    # Rows of one node and key can't be told apart: one of the head's is kept.
    counted = own.groupBy(*own.columns).agg(F.count("*").alias("times"))
    placed = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("place"))
    alone = named.filter(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).alias("links"), F.col("id").alias("component"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("recall"))
    rows = placed.select("id", "links", "component", (F.col("first") & (F.col("place") == 1)).alias("kept"), "recall").unionByName(alone)
    return rows.select(F.col("id").alias(key), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), "kept", "recall")
