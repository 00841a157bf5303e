"""The operators on the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlay.llm.hnsw import near_duplicates as near_vectors
from coverlay.llm.langid import predict_language
from coverlay.llm.lines import drop_shared_lines
from coverlay.llm.mixing import mix
from coverlay.llm.phrases import collocations
from coverlay.llm.pieces import encode_texts, load_vocabulary
from coverlay.llm.quality import score_quality
from coverlay.llm.ranked import rank_documents
from coverlay.llm.sharding import shuffle_into_shards
from coverlay.llm.superminhash import near_duplicates as near_documents
from coverlay.llm.topk import top_k
from coverlay.llm.toxicity import score_toxicity
from coverlay.llm.urls import Rule, after_scheme, filter_urls, path_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of 150 % of all takes from each document."""
    mixed = mix(_table(spark, folder, "documents"))
    taken = mixed.taken().withColumnRenamed("start", "at").withColumnRenamed("source_no", "no")
    rows = mixed.rows.join(taken.hint("merge"), (F.col("size") > 0) & (F.col("source_no") == F.col("no")) & (F.col("start") == F.col("at")), "left")
    sources = mixed.sources.select("source_no", F.col("words").alias("source_size"), "target")
    return rows.join(sources, "source_no").select(
        F.col("key").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = _table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shuffle_into_shards(docs, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(_table(spark, folder, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "alias")


def url_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The same rules where addresses with one path are mirrors: each redirects to the
    smallest url of its path, so a block spreads over hosts."""
    pages = _table(spark, folder, "pages")
    path = path_of(after_scheme(F.col("url")))
    pathed = pages.filter(F.instr("url", "://") > 0).select("url", F.when(path == "", "/").otherwise(path).alias("mirrored"))
    targets = pathed.groupBy("mirrored").agg(F.min("url").alias("to_url"))
    redirects = pathed.join(targets, "mirrored").select(F.col("url").alias("from_url"), "to_url")
    return filter_urls(pages, RULES, redirects=redirects).select("page_id", "host", "path", "rule", "verdict", "alias")


def document_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_documents(_table(spark, folder, "documents"), shingle=3, percent=85)


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def encoding(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each document's three best segmentations, and their scores."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, load_vocabulary(vocabulary))
    other = [F.get("others", F.lit(i)) for i in (0, 1)]
    return encoded.select(
        "doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), *[F.when(o.isNotNull(), F.xxhash64(o)).alias(f"{name}_hash") for name, o in zip(("second", "third"), other, strict=True)],
        F.get("scores", F.lit(0)).alias("best"), F.get("scores", F.lit(1)).alias("second"), F.get("scores", F.lit(2)).alias("third"), "exact",
    )


def language(spark: SparkSession, folder: str) -> DataFrame:
    return predict_language(_table(spark, folder, "documents"))


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def shared_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_shared_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


URL_SQL = """
WITH parts AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
    SELECT page_id, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias
FROM split LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""

ALIAS_SQL = """
WITH parts AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
    FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
nodes AS (
    SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS mirrored,
        CASE WHEN host <> '' THEN host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS node
    FROM split),
judged AS (
    SELECT page_id, mirrored, rule_host || rule_path AS rule, verdict, starts_with(path, rule_path) AS own,
        row_number() OVER (PARTITION BY page_id, starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(mirrored, rule_path)),
longest AS (SELECT page_id, arg_max(verdict, length(rule)) AS verdict FROM judged GROUP BY page_id),
mirrors AS (
    SELECT mirrored, min(node) AS alias, count(DISTINCT node) AS n, bool_or(coalesce(verdict = 'block', false)) AS blocked
    FROM nodes LEFT JOIN longest USING (page_id) WHERE node IS NOT NULL GROUP BY mirrored)
SELECT page_id, host, path, j.rule, coalesce(j.verdict, CASE WHEN n > 1 AND blocked THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN n > 1 AND node IS NOT NULL THEN alias END AS alias
FROM nodes LEFT JOIN (SELECT * FROM judged WHERE own AND place = 1) j USING (page_id) LEFT JOIN mirrors ON nodes.mirrored = mirrors.mirrored AND node IS NOT NULL
"""

# The audit has to find every true link of the queries that it samples.
VECTOR_SQL = """
WITH RECURSIVE whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
sized AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM whole WHERE len(v) > 0),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM sized a JOIN sized b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reached(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x),
counted AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept,
    CASE WHEN s.vec_id IS NOT NULL THEN 1.0::DOUBLE END AS recall
FROM embeddings e JOIN least ON e.vec_id = least.x LEFT JOIN counted ON e.vec_id = counted.x LEFT JOIN (SELECT vec_id FROM sized WHERE norm > 0) s ON e.vec_id = s.vec_id
"""

DOCUMENT_SQL = r"""
WITH RECURSIVE spelt AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM spelt),
sets AS (SELECT hash(list_sort(s)) AS h, list_sort(s) AS s, len(s) AS n, min(doc_id) AS id FROM shingled WHERE len(s) > 0 GROUP BY ALL),
members AS (SELECT doc_id, sets.id FROM shingled JOIN sets ON hash(list_sort(shingled.s)) = h AND list_sort(shingled.s) = sets.s),
spots AS (SELECT id, n, unnest(s) AS g FROM sets),
shared AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM spots a JOIN spots b ON a.g = b.g AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
reached(x, y) AS (SELECT id, id FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM shingled LEFT JOIN members USING (doc_id) LEFT JOIN least ON members.id = least.x
"""

TOP_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place, vec_id, score FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""

PHRASE_SQL = r"""
WITH pieces AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
spelt AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM spelt),
grams AS (
    SELECT lang, w[pos] AS phrase, 1 AS words FROM spots
    UNION ALL SELECT lang, array_to_string(w[pos:pos + 1], ' '), 2 FROM spots WHERE pos + 1 <= len(w)
    UNION ALL SELECT lang, array_to_string(w[pos:pos + 2], ' '), 3 FROM spots WHERE pos + 2 <= len(w)),
f AS (SELECT lang, phrase, words, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 10),
cuts AS (
    SELECT lang, phrase, words, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
    UNION ALL SELECT lang, phrase, words, a, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE words = 3),
scored AS (
    SELECT c.*, x.n AS l, y.n AS r, (1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.n AS HUGEINT) * y.n) AS score
    FROM cuts c JOIN f x ON c.lang = x.lang AND c.head = x.phrase JOIN f y ON c.lang = y.lang AND c.tail = y.phrase),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored),
inner_parts AS (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE words = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE words = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (
    SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score,
        row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, encode(s.phrase)) AS rank
    FROM least s LEFT JOIN longer o ON s.lang = o.lang AND s.phrase = o.phrase
    WHERE place = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
SELECT lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) WHERE rank <= 2000
"""

RANKED_SQL = r"""
WITH spelt AS (
    SELECT doc_id, row_number() OVER () AS no, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
sized AS (SELECT doc_id, no, w, len(w) AS n FROM spelt WHERE len(w) > 0),
corpus AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sized),
tf AS (SELECT no, term, count(*) AS tf FROM (SELECT no, unnest(w) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT doc_id, no, 75 + (25 * n * all_docs) // all_terms AS m FROM sized, corpus),
asked AS (
    SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL),
weighed AS (
    SELECT item_id, term, repeats * CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM asked JOIN df USING (term), corpus),
scored AS (
    SELECT item_id, doc_id, no, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM weighed JOIN tf USING (term) JOIN m USING (no) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""

LINE_SQL = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS no, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, no, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split),
keyed AS (
    SELECT doc_id, no, pos, lines[pos] AS line, translate(
        trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM spots),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT no) >= 10),
marked AS (SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, no
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing,
    "op2_toxicity": toxicity,
    "op3_sharding": sharding,
    "op4_embedding_duplicates": embedding_duplicates,
    "op5_url_filter": url_filter,
    "url_aliases": url_aliases,
    "op6_minhash_duplicates": document_duplicates,
    "op7_exact_top_k": nearest,
    "op8_quality": quality,
    "op9_encoding": encoding,
    "op10_language": language,
    "op11_phrases": phrases,
    "op12_ranked_search": ranked_search,
    "op13_line_dedup": shared_lines,
}
#: Queries that SQL can state; pages of the given tables hold no canonical or refresh tags,
#: which the tests cover instead, so there op5 has rules only and url_aliases has redirects.
CHECKS = {
    "op4_embedding_duplicates": VECTOR_SQL,
    "op6_minhash_duplicates": DOCUMENT_SQL,
    "op5_url_filter": URL_SQL,
    "url_aliases": ALIAS_SQL,
    "op7_exact_top_k": TOP_SQL,
    "op11_phrases": PHRASE_SQL,
    "op12_ranked_search": RANKED_SQL,
    "op13_line_dedup": LINE_SQL,
}
