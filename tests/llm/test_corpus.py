"""Line dedup, ranked search and phrase mining against brute force, with odd inputs."""

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlay.llm import phrases, ranked
from coverlay.llm.lines import drop_shared_lines
from coverlay.llm.phrases import collocations
from coverlay.llm.ranked import rank_documents

DOCS = "doc_id long, text string, lang string, _doc int, line string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, langs=("en",)):
    rows = [(i, t, langs[i % len(langs)], i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- lines ----------------------------------------------------------------------------------


def lines_by_hand(texts, least, chars=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for lines in split for k in {key(line) for line in lines})
    out = []
    for lines in split:
        kept = [line for line in lines if len(key(line)) < chars or held[key(line)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("least, chars", [(2, 1), (3, 4), (1, 1), (99, 1)])
def test_lines_equal_brute_force(spark, least, chars):
    rng = random.Random(least)
    pool = ["Menu", " menu\t", "MENU\r", "", "   ", "É", "é", "unique", "a" * 3000, "İ", "\x1cx\x1c"]
    texts = [None, "", "\n", "\n\n", "Menu", "menu\nbody"] + ["\n".join(rng.choice(pool) + rng.choice(["", str(rng.random())]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += ["same\nMenu\nsame"] * 5
    got = drop_shared_lines(documents(spark, texts), min_documents=least, min_chars=chars)
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "kept_text", "n_lines", "n_dropped"]
    rows = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == lines_by_hand(texts, least, chars)


def test_lines_of_repeated_and_null_keys(spark):
    texts = [(None, "top\nown 1"), (None, "top\nown 1"), (None, None), (7, "top\nown 2"), (7, "top\nown 3"), (7, "top\nown 3")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = drop_shared_lines(docs, min_documents=5).collect()
    assert len(got) == 6 and sorted(r["kept_text"] for r in got) == ["", "own 1", "own 1", "own 2", "own 3", "own 3"]
    assert drop_shared_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        drop_shared_lines(docs.withColumn("n_lines", F.lit(1)))


def test_a_long_text_is_put_together_whole(spark):
    body = [f"line {i}" if i % 3 else "shared" for i in range(60_000)]
    docs = documents(spark, ["\n".join(body), "shared", "x\nShared "])
    got = {r["doc_id"]: r for r in drop_shared_lines(docs, min_documents=3).collect()}
    assert got[0]["kept_text"] == "\n".join(b for b in body if b != "shared") and got[0]["n_dropped"] == 20_000
    assert got[1]["kept_text"] == "" and got[2]["kept_text"] == "x"


# --- ranked search --------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranking_by_hand(docs, items, k):
    spelt = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    spelt = [(d, c) for d, c in spelt if c]
    n, total = len(spelt), sum(sum(c.values()) for _, c in spelt)
    df = Counter(t for _, c in spelt for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for d, c in spelt:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            scored.append((-s, d is None, d))
        ordered = sorted((s for s in scored if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(ordered)]
    return sorted(out, key=str)


def search_case():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "ß", "a_b", "x-1"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)] + [(None, "W1 w2 w3"), (None, "w1"), (5, None), (6, ""), (3, "w1 w2 w2"), (3, "w1 w2 w2")]
    docs += [(1000 + i, "w4 w5 same copy") for i in range(40)] + [(2000, "w6 " * 9000 + "w7")]
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(50, None), (51, "..."), (52, "nowhere"), (None, "w1 w1 w9"), (53, "same copy"), (54, " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"z{i}" for i in range(90)))]
    return docs, items


@pytest.mark.parametrize("k, item_bytes", [(20, 10**6), (3, 300)])
def test_ranking_equals_brute_force(spark, k, item_bytes):
    docs, items = search_case()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = rank_documents(table, asked, k=k, item_bytes=item_bytes)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == ranking_by_hand(docs, items, k)
    assert rank_documents(table.limit(0), asked).count() == rank_documents(table, asked.limit(0)).count() == 0


def test_masks_that_cannot_reach_the_floor_are_not_evaluated():
    """Few documents hold the rare terms: the others share masks whose bound is below."""
    rng = np.random.default_rng(5)
    n, terms = 3000, 12
    tf = (rng.random((terms, n)) < np.linspace(0.9, 0.02, terms)[:, None]).astype(np.int64)
    some = np.flatnonzero(tf.any(axis=0))
    tf, weights = tf[:, some], np.array([100] * 8 + [6000] * 4)
    m, keys = np.full(len(some), 100), np.arange(len(some))
    best = ranked.Best(20)
    scored = ranked.search_group(ranked.Item(np.arange(terms), weights), tf, m, keys, np.zeros(len(some), bool), best)
    whole = weights @ ranked.term_scores(tf, m)
    order = np.lexsort((keys, -whole))[:20]
    assert best.keys.tolist() == order.tolist() and best.scores.tolist() == whole[order].tolist()
    assert scored < len(some) / 4


# --- phrases --------------------------------------------------------------------------------


def phrases_by_hand(rows, longest, least, k, percent=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked_ = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                cuts = [(10**6 * a * a // (counts[p[:c]] * counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p))]
                score, _, left, right = min(cuts)
                ranked_.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked_)[:k]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(9)
    vocabulary = {"en": ["the", "New", "york", "city", "of", "rain", "é", "x\x00y", "x\x1cy"], "fr": ["le", "Grand", "prix", "de"], None: ["a", "b"]}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "en", "en", "fr", None])
        rows.append((lang, "".join(rng.choice(vocabulary[lang]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "; "]) for _ in range(rng.randrange(0, 40)))))
    return rows + [("en", "new york city " * 30), ("en", None), ("fr", ""), (None, None), ("xx", "only here once"), ("en", "!!!"), ("en", "deep blue sea " * 12)] * 2


@pytest.mark.parametrize(
    "partitions, shard_bytes, longest, least, percent",
    [(1, 10**7, 3, 10, 50), (7, 10**7, 4, 6, 90), (3, 200, 3, 10, 50), (40, 60, 2, 3, 50)],
)
def test_phrases_equal_brute_force(spark, partitions, shard_bytes, longest, least, percent):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit(1), "n": F.lit("x")}).repartition(partitions)
    got = collocations(docs, longest=longest, min_count=least, contained_percent=percent, k=15, shard_bytes=shard_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, longest, least, 15, percent)


def test_shards_withhold_what_misses_the_lowered_support(spark):
    """One shard of a language mines at the full support, ten even ones at support 1."""
    text = b"a b c\xffa b\xffx y"
    known = SimpleNamespace(value={"en": 7})
    docs = spark.createDataFrame([("en", bytearray(b"a b c.a b,x y"))], "lang string, text binary")
    rows = {r["phrase"]: (r["n"], r["most"]) for r in phrases.mine(docs, 2, 2, known).collect()}
    assert rows == {"a b": (2, None), None: (7, 2)}
    found, counts, words = phrases.count_phrases("en", text, 2, None, None)
    assert words == 7 and dict(zip(found.to_pylist(), counts.tolist())) == {"a b": 2, "b c": 1, "x y": 1}
    assert collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of 4 * 10^9 make products of 1.6 * 10^25."""
    many = 4 * 10**9
    counts = spark.createDataFrame([("en", "p", 1, many), ("en", "q", 1, many + 1), ("en", "p q", 2, many - 1)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 3 * many)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (counts, totals))
    docs = spark.createDataFrame([("en", "p q")], "lang string, text string")
    got = collocations(docs, longest=2).collect()
    assert [tuple(r) for r in got] == [("en", 1, "p q", many - 1, many, many + 1, 3 * many, 10**6 * (many - 1) ** 2 // (many * (many + 1)))]
