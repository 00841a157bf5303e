"""Classifiers: gradients and marginals against brute force, accuracy on held-out rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlay.llm import chain, langid, quality, samples, subword, toxicity
from coverlay.llm.words import WordTable, batches, sums

LONG = "Wort " * 30_000


def test_word_table_is_a_lookup():
    calls = []

    def lengths(words):
        calls.append(len(words))
        return np.array([[len(w)] for w in words])

    table = WordTable(lengths)
    assert table.rows(["a", "bb", "a"])[:, 0].tolist() == [1, 2, 1]
    assert table.rows(["bb", "ccc"])[:, 0].tolist() == [2, 3] and calls == [2, 1]
    assert list(batches(["a" * 1_000_000, "b" * 1_000_000, "", "c"])) == [(0, 1), (1, 4)] and list(batches([])) == []
    assert sums(np.arange(5.0), np.array([2, 0, 3, 0])).tolist() == [1.0, 0.0, 9.0, 0.0]


def test_marginals_and_gradient_equal_enumeration():
    rng = np.random.default_rng(1)
    links = chain.Links(rng.normal(size=(2, 2)), 0.3)
    lengths = [4, 1, 6, 2]
    start = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
    emission = rng.normal(size=sum(lengths)) * 2
    tags = rng.integers(0, 2, sum(lengths))

    def log_score(e, y, move, first):
        return first * y[0] + sum(a * b for a, b in zip(e, y)) + sum(move[y[i - 1], y[i]] for i in range(1, len(y)))

    def likelihood(emission, move, first):
        total, at = 0.0, 0
        for n in lengths:
            e, y = emission[at : at + n], tags[at : at + n]
            z = sum(np.exp(log_score(e, t, move, first)) for t in itertools.product((0, 1), repeat=n))
            total += log_score(e, y, move, first) - np.log(z)
            at += n
        return total

    want, at = [], 0
    for n in lengths:
        weight = {t: np.exp(log_score(emission[at : at + n], t, links.move, links.first)) for t in itertools.product((0, 1), repeat=n)}
        want += [sum(w for t, w in weight.items() if t[i]) / sum(weight.values()) for i in range(n)]
        at += n
    assert chain.marginals(emission, start, links) == pytest.approx(want)
    by_token, by_move, by_first = chain.gradient(emission, start, links, tags)
    step = 1e-6
    for i in (0, 5, 12):
        moved = emission.copy()
        moved[i] += step
        assert (likelihood(moved, links.move, links.first) - likelihood(emission, links.move, links.first)) / step == pytest.approx(by_token[i], abs=1e-4)
    moved = links.move.copy()
    moved[1, 0] += step
    assert (likelihood(emission, moved, links.first) - likelihood(emission, links.move, links.first)) / step == pytest.approx(by_move[1, 0], abs=1e-4)
    assert (likelihood(emission, links.move, links.first + step) - likelihood(emission, links.move, links.first)) / step == pytest.approx(by_first, abs=1e-4)
    assert chain.marginals(np.zeros(0), np.zeros(0, bool), links).tolist() == []
    assert np.isfinite(chain.marginals(np.full(50_000, 1e6), np.arange(50_000) == 0, links)).all()


def corpus(seed=0, n=260):
    rng = random.Random(seed)
    syllables = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ung", "ein", "pf"]}
    rows = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        good, toxic = int(i % 4 != 0), int(i % 5 == 0)
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        if not good:
            words = [w + "###" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vileword", "vilewords."])
        rows.append((i, " ".join(words), lang, good, toxic))
    return rows


def frames(spark, rows):
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, LONG), (1004, "12 34 !!"), (1005, rows[0][1]), (1006, rows[0][1])]
    docs = spark.createDataFrame([(i, t, lang, None, 7) for i, t, lang, _, _ in rows] + [(i, t, None, None, 7) for i, t in odd], "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, q, x in rows] + [(1003, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(i, q) for i, _, _, q, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} >= {i for i, _ in held}
    assert np.mean([got[i]["predicted"] == q for i, q in held]) >= 0.95
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] and 0 <= got[1000]["score"] <= 1
    assert got[1005]["score"] == got[1006]["score"]
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    rows = corpus()
    docs, _ = frames(spark, rows)
    got = {r["doc_id"]: r for r in langid.predict_language(docs).collect()}
    held = [(i, lang) for i, _, lang, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) >= 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1000, 1001, 1002, 1004))
    assert got[1003]["lang_pred"] in ("de", "en") and sum(r["rejected"] for i, r in got.items() if i < 1000) <= 10
    assert langid.predict_language(docs.limit(0)).count() == 0
    nothing = langid.predict_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == docs.count() and {(r["lang_pred"], r["score"], r["rejected"]) for r in nothing} == {("und", 0.0, True)}


def test_toxicity_on_held_out_rows(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    out = toxicity.score_toxicity(docs, labels).collect()
    got = {r["doc_id"]: r for r in out}
    held = [(i, t, x) for i, t, _, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == x for i, _, x in held]) >= 0.95
    for i, text, x in held:
        found = [text[s["begin"] : s["end"]] for s in got[i]["spans"]]
        assert all("word" in f for f in found) and (not x or found)
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1000]["spans"] == []
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    clean = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert all(r["predicted"] == 0 for r in clean)


def test_fit_learns_and_scorer_equals_plain_average():
    rows = corpus(3, 60)
    model = subword.fit([r[1] for r in rows], [r[2] for r in rows], buckets=1 << 12, epochs=30)
    texts = [r[1] for r in rows[:5]] + ["", "same same other", LONG]
    want = []
    for text in texts:
        buckets, share = subword._features(text, {}, 1 << 12)
        want.append((model.weights[buckets] * share[:, None]).sum(0) + model.bias)
    assert model.scorer().logits(texts) == pytest.approx(np.array(want), abs=1e-9)
    with pytest.raises(ValueError):
        subword.fit([], [])


def test_groups_of_copies_teach_once():
    base = "one two three four five six seven eight nine ten eleven twelve copycue"
    texts = [base + f" x{i}" for i in range(40)] + [f"t{i} u{i} v{i} badcue w{i}" for i in range(20)] + [f"c{i} d{i} e{i} f{i}" for i in range(60)]
    found = toxicity.toxic_words(texts, [1] * 60 + [0] * 60)
    assert "badcue" in found and "copycue" not in found


def test_samples_are_bounded_by_rows_bytes_and_classes(spark):
    def fold(i):
        return zlib.crc32(str(i).encode()) % 5

    (hot, *_), ids = [i for i in range(99) if fold(i)], [i for i in range(1, 400) if fold(i)]
    docs = spark.createDataFrame([(hot, f"copy {n}") for n in range(3000)] + [(i, f"text {i}") for i in ids if i != hot] + [(None, "x"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in {hot, *ids}] * 2 + [(None, 1), (7, None)], "doc_id long, mark int")
    draw = lambda **kw: samples.labelled_texts(docs, labels, "mark", 40, 5, 0, **kw)
    got = draw()
    counts = {y: sum(1 for _, z in got if z == y) for y in (0, 1)}
    assert all(0 < n <= 40 for n in counts.values()) and max(counts.values()) == 40 and got == draw()
    assert len(set(got)) == len(got)
    assert {y for _, y in draw(classes=1)} == {max((0, 1), key=lambda y: (sum(i % 2 == y for i in {hot, *ids}), -y))}
    small = draw(sample_bytes=200)
    assert small and all(sum(len(t) for t, z in small if z == y) <= 100 for y in (0, 1))
    assert samples.labelled_texts(docs, labels.limit(0), "mark", 40, 5, 0) == []
