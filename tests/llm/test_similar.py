"""Near-duplicates, search and segmentation against brute force."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlay.llm import hnsw, pieces, superminhash, topk
from coverlay.llm.forest import Forest
from coverlay.llm.queries import VOCABULARY


def union(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_forest_equals_union_find():
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    forest = Forest(np.arange(200))
    for part in (links[:70], links[70:]):
        forest.join(np.array([a for a, _ in part]), np.array([b for _, b in part]))
    assert forest.parent.tolist() == union(200, links)
    child, parent = forest.edges()
    assert all(forest.parent[c] == p for c, p in zip(child, parent))


def vectors(seed=0, n=700):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    for i in range(0, n, 3):
        base[i] = base[(i * 7) % n] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.08
    for i in range(0, n, 10):
        base[i] = base[1]
    return base


def test_embedding_links_equal_brute_force(spark):
    x = vectors()
    rows = [(i, [float(v) for v in x[i]], i % 3 if i % 13 else None) for i in range(len(x))]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] + [1.0] * 15, 1), (9003, [None] + [1.0] * 15, 1), (9004, [], 1), (9005, [1e200] * 16, 1), (9006, [2e200] * 16, 1), (9007, [1.0] * 3, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows + odd], "vec_id long, embedding array<double>, label int, component_id int")
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = [r[2] for r in rows]
    links = [(i, j) for i in range(len(x)) for j in range(i) if label[i] is not None and label[i] == label[j] and unit[i] @ unit[j] >= 0.98]
    degree = Counter(i for pair in links for i in pair)
    assert len(links) > 500
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.97 * 2 * len(links) <= found <= 2 * len(links)
    roots = union(len(x), links)
    assert np.mean([got[i]["component_id"] == roots[i] for i in range(len(x))]) > 0.98
    assert all(got[i]["n_links"] <= degree[i] for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (9000, 9001, 9002, 9003, 9004, 9007))
    assert got[9005]["n_links"] == got[9006]["n_links"] == 1 and got[9006]["component_id"] == 9005
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_null_and_repeated_keys(spark):
    x, y, z, u = ([float(v) for v in row] for row in np.random.default_rng(9).normal(size=(4, 16)))
    near = [v + 1e-3 for v in x]
    rows = [(None, x, 0), (5, near, 0), (5, near, 0), (5, near, 0), (7, x, 0), (8, u, 0)]
    rows += [(None, y, 0), (None, y, 0), (None, z, 0), (None, None, 0), (None, z, None), (8, y, 1), (8, y, 1), (3, z, 1), (3, u, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(df).collect())
    want = [(None, 4, 5, False), (5, 4, 5, True), (5, 4, 5, False), (5, 4, 5, False), (7, 4, 5, False), (8, 0, 8, True)]
    want += [(None, 1, None, True), (None, 1, None, False), (None, 0, None, True), (None, 0, None, True), (None, 0, None, True)]
    want += [(8, 1, 8, True), (8, 1, 8, False), (3, 0, 3, True), (3, 0, 3, True)]
    assert got == Counter(want)


def test_graph_search_recall():
    x = np.random.default_rng(5).normal(size=(1500, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(unit)
    found = graph.search(unit[:300], 48)
    true = np.argsort(-(unit[:300] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(found[i]) & set(true[i])) / 10 for i in range(300)]) > 0.9
    again = hnsw.Graph(unit, links=np.concatenate(graph.layers, axis=1))
    assert np.array_equal(again.search(unit[:50], 16), graph.search(unit[:50], 16))


@pytest.mark.parametrize("foreign", [False, True])
def test_clusters_that_the_search_misses_are_audited(foreign):
    """More true links than half a beam, none of them reachable from the rest of the graph."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(2000, 16)), rng.normal(size=16) + rng.normal(size=(100, 16)) * 0.01])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(unit)
    entry = {int(graph.order[0])}
    inside = np.arange(2000, 2100)
    for table in graph.layers:
        table[:2000][table[:2000] >= 2000] = -1
    assert not entry & set(inside.tolist())
    queries, own = (x[inside] * 2 + 1e-4, np.full(100, -1)) if foreign else (x[inside], inside)
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    want = q @ unit.T >= 0.98
    if not foreign:
        want[np.arange(100), own] = False
    assert want.sum(1).min() > 32
    got, recalls = np.zeros_like(want), set()
    for a, b, recall in hnsw.find_links(graph, x, queries, own, 0.98):
        got[a, b] = True
        recalls.add(recall)
    assert np.array_equal(got, want) and recalls == {1.0}


def test_misses_of_hard_queries_count_in_the_recall(monkeypatch):
    """33 true links, of which the search finds 32: neither left out of the audit nor taken as whole."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1500, 16)), rng.normal(size=16) + rng.normal(size=(33, 16)) * 1e-3])
    graph = hnsw.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    near, beams = np.arange(1500, 1532, dtype=np.int32), []

    def search(self, queries, beam, stop=0):
        beams.append(beam)
        return np.tile(np.concatenate([near, np.arange(beam - 32, dtype=np.int32)]), (len(queries), 1))

    monkeypatch.setattr(hnsw.Graph, "search", search)
    query = x[1500:1501] * 3
    found = {int(j) for _, b, _ in hnsw.find_links(graph, x, query, np.array([-1]), 0.98) for j in b}
    assert found == set(range(1500, 1533)) and beams[0] == 64


def test_several_shards_and_blocks(spark, monkeypatch):
    x = np.repeat(np.random.default_rng(1).normal(size=(40, 8)), 5, axis=0) + np.random.default_rng(2).normal(size=(200, 8)) * 1e-3
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(200)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 60)
    monkeypatch.setattr(hnsw, "BLOCK_ROWS", 70)
    got = hnsw.near_duplicates(df).collect()
    assert all(r["n_links"] == 4 and r["component_id"] == r["vec_id"] // 5 * 5 for r in got)


def test_top_k_equals_brute_force(spark):
    x = vectors(4, 500)
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(500)] + [(1000, None), (1020, [float("inf")] * 16), (1040, [None] * 16), (1060, [1.0, 2.0]), (1061, [1.0, 0.5]), (1080, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    whole = np.floor(64 * x).astype(int)
    want = []
    for q in range(0, 500, 20):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(500), -scores)) if i != q][:20]
        want += [(q, k + 1, i, int(scores[i])) for k, i in enumerate(order)]
    want.append((1060, 1, 1061, 64 * 64 + 128 * 32))
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.filter("vec_id = 20"), F.lit(True)).count() == 0


def test_scan_block_cuts_most_candidates_and_is_exact_in_long_integers():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    vectors = np.floor(64 * (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 64)))).astype(np.int64)
    for scale in (1, 2**21):
        held, seen = vectors * scale, []
        rows, cands, scores = topk.scan_block(held[:50], held.T.copy(), np.arange(50), np.arange(3000), 20, seen=seen)
        want = vectors[:50].astype(object) @ vectors.T.astype(object) * scale * scale
        assert max(map(abs, want.ravel())) < 2**63 and (scale == 1 or max(map(abs, want.ravel())) > 2**53)
        for i in range(50):
            best = sorted((-want[i, j], j) for j in range(3000) if j != i)[:20]
            mine = sorted((-int(s), int(c)) for r, c, s in zip(rows, cands, scores, strict=True) if r == i)
            assert mine == best
        # Each query has a list of its own: most of it goes at the first look.
        assert seen[0] == 50 * 2999 and seen[1] < 0.5 * seen[0] and seen[-1] < 0.1 * seen[0]


def test_scan_block_prunes_without_loss():
    rng = np.random.default_rng(3)
    columns = (rng.normal(size=(64, 3000)) * np.exp(rng.normal(size=3000)) * 20).astype(np.int64)
    queries = (rng.normal(size=(7, 64)) * 20).astype(np.int64)
    ids = rng.permutation(3000)
    rows, cands, scores = topk.scan_block(queries, columns, np.full(7, ids[0]), ids, 20)
    true = queries @ columns
    for q in range(7):
        order = [i for i in np.lexsort((ids, -true[q])) if i != 0][:20]
        mine = rows == q
        assert cands[mine].tolist() == order and scores[mine].tolist() == true[q, order].tolist()


def texts(seed=0, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 9])):
                copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice([" ", "\n", " \t"]).join(copy))
    return out


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_document_groups_equal_brute_force(spark, shingle, percent):
    docs = texts(1) + ["One Two", "one two", "x", "", None, " \n", "long word " * 20_000, "É x y z", "é x y z"]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(docs)], "doc_id long, text string, component_id string, kept int")
    got = {r["doc_id"]: r for r in superminhash.near_duplicates(df, shingle, percent).collect()}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [shingles(t) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    roots = union(len(docs), links)
    assert len(set(roots)) < len(docs)
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), roots[i], roots[i] == i)
    assert superminhash.near_duplicates(df.limit(0), shingle, percent).count() == 0


def test_documents_with_null_and_repeated_keys(spark):
    long, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(4, long, "x"), (4, long, "x"), (4, long + " end", "x"), (9, long.upper(), "x"), (None, long + " z", "x")]
    rows += [(None, other, "x"), (None, other, "y"), (None, other + " z", "x"), (None, "alone here", "x"), (2**60 + 1, "single text", "x")]
    rows += [(6, third, "y"), (6, third, "x"), (6, "quite another", "x"), (None, None, "x"), (None, None, "x"), (6, "", "x"), (6, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(df).collect())
    want = [(4, 56, 4, True), (4, 56, 4, False), (4, 57, 4, False), (9, 56, 4, False), (None, 57, 4, False)]
    want += [(None, 56, None, True), (None, 56, None, False), (None, 57, None, False), (None, 1, None, True), (2**60 + 1, 1, 2**60 + 1, True)]
    want += [(6, 56, 6, True), (6, 56, 6, False), (6, 1, 6, True), (None, 0, None, True), (None, 0, None, True), (6, 0, 6, True), (6, 0, 6, True)]
    # Of the rows of one key and component, the text's digest says which is kept.
    assert Counter((k, cid, stays) for k, _, cid, stays in got.elements()) == Counter((k, cid, stays) for k, _, cid, stays in want)
    assert Counter((k, n) for k, n, _, _ in got.elements()) == Counter((k, n) for k, n, _, _ in want)
    kept = superminhash.keep_one(df).collect()
    assert len(kept) == sum(k for *_, k in got.elements())
    assert Counter(r["doc_id"] for r in kept) == Counter(k for k, _, _, stays in got.elements() if stays)
    assert sum(r["text"] in (third, other, other + " z") for r in kept) == 2
    assert superminhash.keep_one(df.limit(0)).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK_DOCS", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for k in range(40):
        copy = base[: 60 - k % 9]
        copy[rng.randrange(len(copy))] = f"edit{k}"
        docs.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(df, 3, 85).collect()}
    sets = [{tuple(d.split()[i : i + 3]) for i in range(len(d.split()) - 2)} for d in docs]
    links = [(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert [got[i] for i in range(40)] == union(40, links)


def test_superminhash_equals_the_plain_algorithm():
    """One element after the other, shuffling a whole permutation."""
    rng = np.random.default_rng(0)
    places = 32
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 5, 40, 300)]
    got = superminhash.superminhash(np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets]), 4, places)
    for row, elements in zip(got, sets):
        want = [2**64 - 1] * places
        for e in elements:
            order = list(range(places))
            for step in range(places):
                draw = int(superminhash.mixed(np.array([(int(e) + (step + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
                other = step + ((draw >> 32) * (places - step) >> 32)
                order[step], order[other] = order[other], order[step]
                want[order[step]] = min(want[order[step]], step << 32 | draw & 0xFFFFFFFF)
        # Beyond the early stop nothing could be smaller.
        assert row.tolist() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = pool[:300], pool[50:]
        s = superminhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        errors.append((s[0] == s[1]).mean() - 250 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(VOCABULARY)


@needs_vocabulary
@pytest.mark.parametrize("text", ["hello", "the cat", "a\nb  c", "Ü☃▁x", " ", "  lead", "end ", "naïve é", "\x00​", "日本 𝒳", "aaaaaaaa"])
def test_n_best_equals_enumeration(vocabulary, text):
    encoder = pieces.Encoder(vocabulary)
    into = encoder.lattice.edges(" " + text)

    def paths(j):
        if j == 0:
            yield 0.0, ()
        for i, score, ids in into[j] if j else ():
            for a, b in paths(i):
                yield a + score, b + ids

    want = sorted(paths(len(text) + 1), key=lambda p: -p[0])[:5]
    ((ids, scores, spell),) = encoder.encode([text], 5)
    assert scores == pytest.approx([s for s, _ in want])
    full = spell()
    assert len(set(full)) == len(full) == len(want) and all(encoder.decode(p) == text for p in full)
    assert tuple(ids.tolist()) in full and encoder.decode(ids) == text
    value = lambda p: sum(vocabulary.scores[i] if vocabulary.plain[i] else encoder.lattice.byte_score for i in p)
    assert [value(p) for p in full] == pytest.approx(scores)
    assert [p for p in pieces.n_best(into, 5)] == [(s, p) for s, p in pieces.n_best(into, 5)]


@needs_vocabulary
def test_all_segmentations_are_returned(spark, vocabulary):
    texts = ["the cat", "a\nb  c", "Ü☃▁x", "", "aaaaaaaa", "x", "naïve é " * 500 + "unusualword"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    encoder = pieces.Encoder(vocabulary)
    value = lambda p: sum(vocabulary.scores[i] if vocabulary.plain[i] else encoder.lattice.byte_score for i in p)
    for row in pieces.encode_texts(df, vocabulary).collect():
        found = [row["ids"], *row["others"]]
        assert len(found) == len(row["scores"]) == len(set(map(tuple, found))) and row["exact"]
        assert [value(p) for p in found] == pytest.approx(row["scores"])
        assert all(encoder.decode(p) == row["text"] for p in found)
    ab, ac, aab = (next(encoder.encode([t]))[0] for t in ("ab", "ac", "aab"))
    assert encoder.same(ab, ab) and not any(encoder.same(*pair) for pair in ((ab, ac), (ab, aab), (aab, ab), (ab[:0], ab)))


@needs_vocabulary
def test_encoding_round_trip(spark, vocabulary):
    rows = [(1, "Hello world\n\nagain"), (2, None), (3, ""), (4, "日本語 ☃ ▁ x" * 3000), (5, "Hello world\n\nagain"), (6, "x")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, other string")
    out = pieces.encode_texts(df, vocabulary)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["ids"] is None and got[2]["exact"] is None and got[3]["ids"] == [] and got[3]["scores"] == [0.0]
    assert all(got[i]["exact"] for i in (1, 3, 4, 5, 6)) and got[1]["ids"] == got[5]["ids"]
    assert got[1]["scores"] == sorted(got[1]["scores"], reverse=True) and len(got[1]["scores"]) == 3
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode_ids(out, vocabulary).collect()}
    assert back == dict(rows)
    assert pieces.encode_texts(df.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        pieces.encode_texts(out, vocabulary)


@needs_vocabulary
@pytest.mark.parametrize("text", ["a" * 2_000, "a" * 3_001, "a" * 9_999, "ab" * 3_500, "=" * 12_001])
def test_agenda_of_long_runs_is_bounded(vocabulary, monkeypatch, text):
    into = pieces.Lattice(vocabulary).edges(" " + text)
    edges, pushed = sum(map(len, into)), 0

    def push(agenda, entry, push=pieces.heapq.heappush):
        nonlocal pushed
        pushed += 1
        assert pushed <= 3 * edges
        push(agenda, entry)

    monkeypatch.setattr(pieces.heapq, "heappush", push)
    found = pieces.n_best(into, 3)
    # The three best scores of each place's beginnings, place after place.
    best = [[0.0]]
    for ends in into[1:]:
        best.append(sorted((x + s for i, s, _ in ends for x in best[i]), reverse=True)[:3])
    assert [s for s, _ in found] == pytest.approx(best[-1])
    assert len({p for _, p in found}) == 3
