"""Line dedup: lines that many documents share are dropped from all of them.

Normalised lines are exploded and hashed, documents are counted per hash, and each document
is put together again from the positions of its other lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.llm.columns import ascii_lower
from coverlay.operators.lineage import settle
from coverlay.operators.lookup import lookup

BLANKS = " \t\n\x0b\x0c\r"
ADDED = ("kept_text", "n_lines", "n_dropped")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    """The key of each line: stripped and in lower case."""
    return F.transform(_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def _digest(*parts: Column) -> list[Column]:
    """128 bits as two numbers: no two lines of any corpus are likely to share them."""
    return [F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit(1), *parts).alias("_b")]


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """``_a, _b, documents``: how many documents hold each line key, once per document."""
    own = F.array_distinct(F.filter(_keys(F.col(text)), lambda line: F.char_length(line) >= min_chars))
    return docs.select(F.explode(own).alias("line")).select(*_digest(F.col("line"))).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("documents"))


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """Every document with ``kept_text, n_lines, n_dropped`` added.

    A line's key is the line without blanks at its ends, A-Z in lower case.  Keys of at least
    ``min_chars`` code points that at least ``min_documents`` documents hold lose all their
    lines; the other lines stay as they are, in order.  Each row is a document: repeated rows
    and repeated or null keys count one by one.  A null or empty text is one empty line; a
    text that loses all its lines is empty.  No rows give no rows.  Other columns pass
    through, whatever their names; the added ones must not exist.

    Only hashes of lines are shuffled, summed map-side to be counted; lines that hold a large
    part of all lines are looked up by broadcast, a bounded number of them.
    """
    clash = set(ADDED) & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    words = [F.col(key), F.col(text)]
    counts = settle(line_counts(docs, text, min_chars).filter(F.col("documents") >= min_documents))
    total = counts.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    placed = docs.select(F.xxhash64(*words).alias("_doc"), F.xxhash64(F.lit(1), *words).alias("_doc2"), F.posexplode(_keys(F.col(text))).alias("_at", "_line"))
    hashed = placed.filter(F.char_length("_line") >= min_chars).select("_doc", "_doc2", "_at", *_digest(F.col("_line")))
    found = lookup(hashed, counts, ["_a", "_b"], "documents", total, "_found", ["_doc", "_at"])
    # Rows equal in key and text share a group and what it drops.
    dropped = found.filter(F.col("_found").isNotNull()).groupBy("_doc", "_doc2").agg(F.collect_set("_at").alias("_gone"))
    whole = docs.select(F.struct("*").alias("_row"), F.xxhash64(*words).alias("_doc"), F.xxhash64(F.lit(1), *words).alias("_doc2"))
    joined = whole.join(dropped, ["_doc", "_doc2"], "left")
    old = F.col("_row").getField(text)
    lines = _lines(old)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce(old, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns],
        kept.alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
