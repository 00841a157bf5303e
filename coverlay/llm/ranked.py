"""Ranked lexical search: documents grouped by which of an item's terms they hold.

Documents become sparse vectors of the items' terms once.  Then, block of documents by block,
an item's documents are grouped by their presence mask, a bitmap over the item's terms.  All
documents of a mask share an upper bound of their score; masks are evaluated by falling bound
until no mask left can reach the k-th best score held.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlay.operators.lineage import shared_folder

#: Bytes of item texts that are searched for at once; more items make more blocks.
ITEM_BYTES = 4_000_000
#: Documents of about one length that are looked at together.
GROUP = 4_096
#: The second-best lists of a task are merged in so many parts before the last ranking.
PARTS = 64
#: UTF-8 bytes of terms as they are, A-Z in lower case, all others blank.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and everything beyond ASCII, A-Z in lower case."""
    return text.translate(TERM_BYTES).split()


class Item(NamedTuple):
    """An item's terms by number, and each one's weight times its repeats in the item."""

    terms: np.ndarray
    weights: np.ndarray


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def length_factor(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``100 - 25 + (25 n N) div L``, in whole numbers of any size."""
    different, back = np.unique(sizes, return_inverse=True)
    return np.array([75 + 25 * int(n) * n_docs // n_terms for n in different], np.int64)[back]


def term_scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """The k best documents of an item: highest score, then smallest key, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.keys, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """A score below this is in no result."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.floor
        scores, keys, nulls = (np.concatenate(pair) for pair in ((self.scores, scores[good]), (self.keys, keys[good]), (self.nulls, nulls[good])))
        first = np.lexsort((keys, nulls, -scores))[: self.k]
        self.scores, self.keys, self.nulls = scores[first], keys[first], nulls[first]


def masks_of(tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct presence masks, one row of bits each, and every document's mask number."""
    packed = np.packbits(tf > 0, axis=0)
    width = -(-len(packed) // 8) * 8
    bitmap = np.zeros((tf.shape[1], width), np.uint8)
    bitmap[:, : len(packed)] = packed.T
    rows = bitmap.view(np.uint64)[:, 0] if width == 8 else bitmap.view(f"V{width}")[:, 0]
    _, first, number = np.unique(rows, return_index=True, return_inverse=True)
    return tf[:, first] > 0, number


def search_group(item: Item, tf: np.ndarray, m: np.ndarray, keys: np.ndarray, nulls: np.ndarray, best: Best) -> int:
    """Put the group's documents into ``best``; the number of documents that were scored.

    ``tf``: one row per term of the item, one column per document, each with a term at least.
    """
    masks, number = masks_of(tf)
    # What a mask can reach: each of its terms as often as it comes, in the shortest document.
    reach = item.weights * term_scores(tf.max(axis=1), m.min())
    bounds = reach @ masks
    order = np.argsort(-bounds, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = np.argsort(place[number], kind="stable")
    ends = np.cumsum(np.bincount(place[number], minlength=len(order)))
    done, mask, batch = 0, 0, max(64, 4 * best.k)
    while mask < len(order) and bounds[order[mask]] >= best.floor:
        last = min(int(np.searchsorted(ends, done + batch)), len(order) - 1)
        # Masks after the first that cannot reach the floor are left as well.
        last = min(last, int(np.searchsorted(-bounds[order], -best.floor, side="right")) - 1)
        chosen = docs[done : ends[last]]
        scores = item.weights @ term_scores(tf[:, chosen], m[chosen])
        best.add(scores, keys[chosen], nulls[chosen])
        done, mask, batch = int(ends[last]), last + 1, 2 * batch
    return done


def search_block(items: list[Item], sizes, m, keys, nulls, offsets, terms, counts, best: list[Best]) -> int:
    """All items against a block of documents, short ones first; the number of scorings."""
    scored = 0
    doc_of = np.repeat(np.arange(len(sizes)), np.diff(offsets))
    by_length = np.argsort(m, kind="stable")
    for begin in range(0, len(sizes), GROUP):
        group = by_length[begin : begin + GROUP]
        where = np.full(len(sizes), -1)
        where[group] = np.arange(len(group))
        here = where[doc_of] >= 0
        doc, term, count = where[doc_of[here]], terms[here], counts[here]
        order = np.argsort(term, kind="stable")
        doc, term, count = doc[order], term[order], count[order]
        for item, kept in zip(items, best, strict=True):
            first, last = np.searchsorted(term, item.terms), np.searchsorted(term, item.terms, side="right")
            tf = np.zeros((len(item.terms), len(group)), np.int64)
            for row, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                tf[row, doc[a:b]] = count[a:b]
            some = np.flatnonzero(tf.any(axis=0))
            if len(some):
                scored += search_group(item, tf[:, some], m[group[some]], keys[group[some]], nulls[group[some]], kept)
    return scored


def _vectors(docs: DataFrame, numbers, key: str, text: str) -> DataFrame:
    """``key, n, terms, counts`` of each document with a term: its size and the known terms."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            keys, sizes, found, counts = [], [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(body.as_py() or b"")
                if words:
                    tally = [(known[w], c) for w, c in Counter(words).items() if w in known]
                    keys.append(doc)
                    sizes.append(len(words))
                    found.append([t for t, _ in tally])
                    counts.append([c for _, c in tally])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["key", "n", "terms", "counts"],
            )

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(spell, "key long, n long, terms array<int>, counts array<long>")


def _best_of_tasks(vectors: DataFrame, items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            terms, keys = column["terms"], column["key"]
            sizes = column["n"].to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            offsets = terms.offsets.to_numpy().astype(np.int64)
            search_block(
                asked, sizes, length_factor(sizes, n_docs, n_terms), keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False),
                offsets - offsets[0], terms.flatten().to_numpy(zero_copy_only=False), column["counts"].flatten().to_numpy(zero_copy_only=False), best,
            )
        for number, b in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b.scores), number, np.int32)), pa.array(b.keys, mask=b.nulls), pa.array(b.scores)], ["no", "key", "score"]
            )

    return vectors.mapInArrow(search, "no int, key long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item, rank, key, score``: the ``k`` best documents of each item with a score above 0.

    Terms, weights and scores are whole numbers as in ``weight``, ``length_factor`` and
    ``term_scores``; equal scores go to the smaller key, null keys last.  ``key`` must be a
    whole number.  Each row of ``docs`` is a document: repeated rows are ranked one by one.
    Item rows equal in id and text are one item, other rows with one id are ranked apart.
    Null and empty texts hold no term: such documents count for nothing, such items have no
    rows; nor has anything if either table is empty.  Other columns are not read.

    Items are the stated query set and pass the driver in blocks of about ``item_bytes``;
    each block reads the documents' texts once and its vectors twice.  A task returns ``k``
    rows per item at most, so no group of documents meets in one place.
    """
    spark = docs.sparkSession
    queries = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("text")).filter(F.octet_length("text") > 0).distinct()
    size = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // item_bytes))
    folder = shared_folder(spark, "ranked")
    names = items.select(F.col(item).alias("item")).schema
    for block in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        found = _search(docs, [(r["item"], terms_of(bytes(r["text"]))) for r in asked], names, key, text, k, f"{folder}/vectors-{block}")
        found.write.parquet(f"{folder}/block={block}")
    ranked = spark.read.parquet(*[f"{folder}/block={block}" for block in range(blocks)])
    return ranked.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def _search(docs: DataFrame, asked: list, names, key: str, text: str, k: int, folder: str) -> DataFrame:
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    numbers: dict[bytes, int] = {}
    for _, terms in asked:
        for term in terms:
            numbers.setdefault(term, len(numbers))
    _vectors(docs, context.broadcast(numbers), key, text).write.parquet(folder)
    vectors = spark.read.schema("key long, n long, terms array<int>, counts array<long>").parquet(folder)
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for each term of the block of items at most.
    held = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    searched = []
    for _, terms in asked:
        repeats = Counter(numbers[t] for t in terms)
        searched.append(Item(np.array(sorted(repeats), np.int64), np.array([repeats[t] * weight(n_docs, held.get(t, 0)) for t in sorted(repeats)], np.int64)))
    best = _best_of_tasks(vectors, context.broadcast(searched), n_docs, max(n_terms, 1), k)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    some = best.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("no", "part").orderBy(*order))).filter(F.col("at") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= k)
    schema = f"no int, item {names[0].dataType.simpleString()}"
    ids = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(asked)], schema)
    # The block's items, bounded by its bytes.
    return ranked.join(F.broadcast(ids), "no").select("item", "rank", "key", "score")
