"""Mixing, sharding and URL filter against brute force, with odd inputs."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from coverlay.llm import mixing, sharding, urls
from coverlay.llm.columns import uniform
from coverlay.llm.components import components
from coverlay.llm.queries import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def documents(spark, n=120):
    rows = []
    for i in range(n):
        words = "" if i % 17 == 0 else " ".join(f"w{(i * 7 + k) % 91}" for k in range(i * 13 % 150))
        source = None if i % 11 == 0 else f"s{i % 4}" if i % 3 else "hot"
        rows.append((i, None if i % 19 == 0 else f" \n{words}\t", "en", source, 0, 1))
    rows += [(3, "same row", "en", "s1", 0, 1)] * 2 + [(7, "long " * 5000, "en", "s2", 0, 1)]
    return spark.createDataFrame(rows, DOCS)


def water_fill(words, weights=(5, 2, 1), share=1.5, most=2.0):
    """The rounds as they are told: share by weight, stop the full, share the excess again."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(words.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            room = most * words[s] - target[s]
            if part[s] >= room:
                left += part[s] - room
                target[s] = most * words[s]
                open_.discard(s)
            else:
                target[s] += part[s]
    return target


def test_mix_meets_targets_and_bounds(spark):
    docs = documents(spark)
    planned = mixing.mix(docs, block_words=8, shard_slots=64)
    size = lambda t: len((t or "").encode().split())
    words, rows = Counter(), docs.collect()
    for r in rows:
        words[r["source"]] += size(r["text"])
    want = water_fill(words)
    got = {r["source"]: r for r in planned.sources.collect()}
    assert set(got) == set(want)
    for s, t in want.items():
        assert got[s]["target"] == pytest.approx(t) and got[s]["words"] == words[s]
    taken = {(r["source_no"], r["start"]): r["taken"] for r in planned.taken().collect()}
    held = planned.rows.collect()
    assert len(held) == len(rows)
    per_source = Counter()
    for r in held:
        n = taken[r["source_no"], r["start"]] if r["size"] else 0
        assert 0 <= n <= 2 * r["size"]
        per_source[r["source_no"]] += n
    for r in got.values():
        assert abs(per_source[r["source_no"]] - r["target"]) <= 3 * 8
    slots = planned.slots.collect()
    assert len({(s["shard"], s["place"]) for s in slots}) == len(slots) == sum(r["quota"] for r in got.values())
    # A pass takes each block once.
    assert len({(s["source_no"], s["epoch"], s["block"]) for s in slots}) == len(slots)
    again = mixing.mix(docs, block_words=8, shard_slots=64).slots.collect()
    assert sorted(slots) == sorted(again)


def test_small_sources_meet_their_targets(spark):
    rows = [(i, f"w{i} " * 10, "en", f"s{i // 10}", 0, i) for i in range(40)] + [(i, "x", "en", "one", 0, i) for i in range(40, 43)]
    planned = mixing.mix(spark.createDataFrame(rows, DOCS))
    taken = {r["source_no"]: r["n"] for r in planned.taken().groupBy("source_no").agg(F.sum("taken").alias("n")).collect()}
    for r in planned.sources.collect():
        assert abs(taken[r["source_no"]] - r["target"]) <= max(1, 0.05 * r["target"])
        assert taken[r["source_no"]] <= 2 * r["words"]


def test_mixed_texts_keep_columns_of_any_name(spark):
    text = "some words " * 40
    rows = [(None, text, "a", 7, "h", "k", "r"), (1, text, "a", 8, "h2", "k2", "r2"), (1, text, "a", 8, "other", "k2", "r2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, hash string, key string, runs string")
    planned = mixing.mix(docs, block_words=8)
    out = mixing.mixed_texts(docs, planned)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(len(r["text"].split()) for r in got) == planned.taken().agg(F.sum("taken")).first()[0]
    assert {r["runs"] for r in got} == {"r", "r2"} and all(r["text"] in text for r in got)


def test_mixed_texts_are_what_the_plan_takes(spark):
    docs = documents(spark).dropDuplicates(["doc_id"])
    planned = mixing.mix(docs, block_words=8)
    out = mixing.mixed_texts(docs, planned)
    assert out.columns == docs.columns
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = defaultdict(int)
    for r in out.collect():
        assert r["text"] in whole[r["doc_id"]] and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(r["text"].split())
    start = {(r["source_no"], r["start"]): r["key"] for r in planned.rows.filter("size > 0").collect()}
    want = {start[r["source_no"], r["start"]]: r["taken"] for r in planned.taken().collect() if r["taken"]}
    assert dict(got) == want


def test_mix_of_nothing(spark):
    empty = mixing.mix(spark.createDataFrame([], DOCS))
    assert empty.slots.count() == empty.sources.count() == empty.taken().count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1)], DOCS))
    assert blank.slots.count() == 0 and [r["target"] for r in blank.sources.collect()] == [0.0, 0.0]
    assert mixing.mixed_texts(spark.createDataFrame([(2, "", "en", "a", 0, 1)], DOCS), blank).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_index_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), 3, F.lit("s"))).collect()]
    assert sorted(got) == list(range(n))
    assert n < 1000 or got != sorted(got)


def test_hypergeometric_draws(spark):
    total, good, draws = 20, 7, 9
    column = sharding.hypergeometric(*(F.lit(x).cast("long") for x in (total, good, draws)), uniform(1, F.col("id")))
    got = Counter(r[0] for r in spark.range(20_000).select(column).collect())
    for x in range(8):
        p = math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws)
        assert abs(got[x] - 20_000 * p) < 5 * math.sqrt(20_000 * p) + 1
    edges = [(0, 0, 0, 0), (5, 5, 3, 3), (5, 0, 3, 0), (5, 2, 5, 2)]
    for n, k, d, want in edges:
        assert spark.range(3).select(sharding.hypergeometric(*(F.lit(x).cast("long") for x in (n, k, d)), uniform(F.col("id")))).distinct().collect() == [(want,)]


@pytest.mark.parametrize("total, good, draws", [(20_000, 1250, 10_000), (1000, 500, 500), (20_000, 19_000, 700)])
def test_wide_draws_follow_the_law(spark, total, good, draws):
    column = sharding.hypergeometric(*(F.lit(x).cast("long") for x in (total, good, draws)), uniform(1, F.col("id")))
    got = Counter(r[0] for r in spark.range(50_000).select(column).collect())
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    likely = {x: 50_000 * math.exp(log(good, x) + log(total - good, draws - x) - log(total, draws)) for x in range(max(0, draws - total + good), min(good, draws) + 1)}
    likely = {x: e for x, e in likely.items() if e > 20}
    chi = sum((got[x] - e) ** 2 / e for x, e in likely.items())
    assert chi < len(likely) + 5 * math.sqrt(2 * len(likely))
    assert sum(got[x] for x in likely) > 49_000


def test_matrix_of_many_partitions_in_several_tasks(spark):
    sizes = spark.range(4096).select(F.col("id").cast("int").alias("part"), (F.lit(20_000) + F.col("id") % 100).alias("n"))
    matrix = sharding.communication_matrix(sizes, 12, 16)
    assert matrix.rdd.getNumPartitions() >= 16
    rows = matrix.collect()
    assert len(rows) == 4096 and all(sum(r["counts"]) == 20_000 + r["part"] % 100 for r in rows)
    shards = [sum(r["counts"][k] for r in rows) for k in range(16)]
    assert max(shards) - min(shards) <= 1


def test_shards_depend_on_no_setting_and_touch_no_column(spark):
    df = spark.range(3000).select("id", F.lit(7).alias("part"), F.lit("keep").alias("place"), F.lit(1).alias("_start"), F.lit(2).alias("in0"), F.lit(3).alias("cuts"))
    setting, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 64, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = sharding.shuffle_into_shards(df, ["id"], seed=2)
            assert out.columns == [*df.columns, "shard", "slot"]
            seen.append(sorted(out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    assert seen[0] == seen[1] == seen[2]
    assert {tuple(r[1:6]) for r in seen[0]} == {(7, "keep", 1, 2, 3)}
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(df.withColumnRenamed("cuts", "Slot"), ["id"])


def test_communication_matrix_has_the_given_sums(spark):
    sizes = {0: 500, 1: 0, 2: 3, 3: 120, 5: 77}
    rows = spark.createDataFrame([(p, n) for p, n in sizes.items()], "part int, n long")
    matrix = {r["part"]: r["counts"] for r in sharding.communication_matrix(rows, 3, 4).collect()}
    assert {p: sum(c) for p, c in matrix.items()} == {p: sizes.get(p, 0) for p in range(8)}
    assert sorted(sum(c[k] for c in matrix.values()) for k in range(4)) == [175, 175, 175, 175]


@pytest.mark.parametrize("n", [0, 1, 5, 16, 1003])
def test_shards_are_exact_and_gapless(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 2).alias("extra"))
    got = sharding.shuffle_into_shards(df, ["id"], shards=16, seed=5).collect()
    assert sorted(r["id"] for r in got) == list(range(n))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shuffle_into_shards(df.repartition(3), ["id"], shards=16, seed=5).collect()
    assert sorted(got) == sorted(again)


def test_shards_of_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(None, "a")] * 5 + [(1, "x")] * 6 + [(2, None)] * 3, "id long, t string")
    got = sharding.shuffle_into_shards(df, ["id", "t"], shards=4).collect()
    assert Counter((r["id"], r["t"]) for r in got) == Counter((r["id"], r["t"]) for r in df.collect())
    assert sorted(Counter(r["shard"] for r in got).values()) == [3, 3, 4, 4]
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(df.withColumn("slot", F.lit(1)), ["id"])


def test_shuffle_is_uniform_over_shards(spark):
    """Each row's shard over many seeds: every shard about equally often."""
    seen = Counter()
    df = spark.range(40)
    for seed in range(12):
        seen.update((r["shard"]) for r in sharding.shuffle_into_shards(df, ["id"], shards=4, seed=seed).filter("id < 10").collect())
    assert all(10 <= seen[s] <= 55 for s in range(4))


def test_components_equal_union_find(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (5, 5), (None, 3), (70, 300), (300, 299)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 160), 100) | dict.fromkeys((200, 201, 202), 200) | dict.fromkeys((70, 299, 300), 70)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = "page_id long, url string, html string, verdict_of_other string"


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://WWW.example.com/en/x?q#f", "<link href='http://a.org/1' rel=canonical>"),
        (2, "http://m.example.com/en/1", None),
        (3, "http://a.org/1", "<META http-equiv='Refresh' content='0; URL=/2'>"),
        (4, "http://a.org/2#z", '<LINK REL="canonical" HREF="http://q.net/es/7">'),
        (5, None, "<link rel=canonical href='http://q.net/es/7'>"),
        (6, "nothing", "x"),
        (7, "https://a.org", "<link rel=canonical href=2>"),
        (8, "http://b.org/", "<p>canonical</p><link rel=stylesheet href='http://q.net/es/7'>"),
        (9, "http://xcom/", ""),
        (10, "http://shop.com/", '<link rel="canonical" href="//q.net/fr/8">'),
        (11, "http://com/", "a" * 100_000),
        (11, "http://com/", "a"),
        (12, "http://q.net/de/1", None),
        (13, "http://c.org/old", None),
    ]
    pages = spark.createDataFrame([(*r, None) for r in rows], PAGES)
    redirects = spark.createDataFrame([("http://c.org/old", "http://example.com/en/new"), (None, "x")], "from_url string, to_url string")
    out = urls.filter_urls(pages, RULES, redirects=redirects)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows) and "verdict_of_other" in out.columns
    assert got == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("m.example.com", "/en/1", "example.com/en/", "block"),
        3: ("a.org", "/1", None, "block"),
        4: ("a.org", "/2", None, "block"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("a.org", "", None, "block"),
        8: ("b.org", "/", None, "allow"),
        9: ("xcom", "/", None, "allow"),
        10: ("shop.com", "/", "com/", "allow"),
        11: ("com", "/", "com/", "allow"),
        12: ("q.net", "/de/1", None, "allow"),
        13: ("c.org", "/old", None, "block"),
    }
    with pytest.raises(ValueError):
        urls.filter_urls(pages.withColumn("rule", F.lit(1)), RULES)
    assert urls.filter_urls(pages.limit(0), RULES).count() == 0


def test_crc_of_the_key(spark):
    from coverlay.llm.columns import fold_of

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "id long")
    got = {r["id"]: r["f"] for r in df.select("id", fold_of(F.col("id"), 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)} | {None: 0}


def judged_by(spark, pages, rules, **kwargs):
    """The rule and verdict of each (host, path), through the operator's joins."""
    table = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    got = urls.judge(spark.createDataFrame(list(pages), "host string, path string"), table, **kwargs).collect()
    assert len(got) == len({(r["host"], r["path"]) for r in got})
    return {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in got}


def test_rules_of_one_length_allow_first_then_by_name(spark):
    judged = lambda *rules: judged_by(spark, [("a.com", "/abc")], rules)["a.com", "/abc"]
    allow, block = urls.Rule("allow", "a.com", "/"), urls.Rule("block", "com", "/ab")
    assert len(allow.name) == len(block.name)
    for rules in ((allow, block), (block, allow)):
        assert judged(*rules) == (allow.name, "allow")
    other = urls.Rule("allow", "com", "/ab")
    assert judged(other, allow) == judged(allow, other) == ("a.com/", "allow")
    assert judged(allow, urls.Rule("block", "com", "/abc")) == ("com/abc", "block")
    assert judged(block, other) == ("com/ab", "allow")


def test_a_hundred_thousand_rules_broadcast_or_shuffled(spark):
    rules = [urls.Rule(("block", "allow")[i % 7 == 0], f"h{i % 20_000}.{('org', 'net', 'co.uk')[i % 3]}", "/" + "p/" * (i // 20_000)) for i in range(100_000)]
    rules += [urls.Rule("block", "org", "/p/p"), urls.Rule("allow", "", ""), urls.Rule("block", "uk", "")]
    pages = [(f"{sub}h{i}.{top}", path) for i in range(0, 20_000, 97) for sub in ("", "www.", "a.b.", "x") for top in ("org", "net", "co.uk") for path in ("", "/", "/p/p/", "/p/p/p/p/q")]
    pages += [("", ""), ("org.", "/p/p"), (".org", "/p/p"), ("a" * 5000 + ".org", "/p/p" * 500)]
    by_host = defaultdict(list)
    for r in rules:
        by_host[r.host].append(r)
    want = {}
    for host, path in pages:
        labels = host.split(".")
        fits = [r for k in range(len(labels)) for r in by_host[".".join(labels[k:])] if path.startswith(r.path)]
        if fits:
            best = min(fits, key=lambda r: (-len(r.name), r.verdict, r.name))
            want[host, path] = best.name, best.verdict
    assert judged_by(spark, pages, rules) == judged_by(spark, pages, rules, broadcast_bytes=0) == want


def test_pages_with_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/1", None, 1, "x", 2, {"k": 1})] * 2, "page_id long, url string, html string, node int, _n string, _lookup_turn int, m map<string,int>")
    got = urls.filter_urls(pages, RULES).collect()
    assert [(*r[:7], r["verdict"], r["alias"]) for r in got] == [(*pages.first(), "block", None)] * 2
    with pytest.raises(ValueError):
        urls.filter_urls(pages.withColumnRenamed("m", "Verdict"), RULES)
    assert {r["verdict"] for r in urls.filter_urls(pages, []).collect()} == {"allow"}
