"""Near-duplicate documents by SuperMinHash signatures.

1. A document's words give a set of hashed shingles.  Documents of one set are represented
   by the row with the smallest id.
2. SuperMinHash: every element visits the signature's places in a random order of its own and
   offers at its n-th place a number in [n, n + 1); each place keeps its smallest.  All
   elements take their first step, then those of unfinished documents their second, and a
   document stops as soon as each of its places holds a smaller number than could follow.
3. Bands of the signature are hashed.  Documents of one bucket are tied to the bucket's
   smallest one, which gives groups of candidates that share buckets, directly or through
   others.
4. Within a group, documents are blocked by the size of their sets, and blocks whose sizes
   allow the wanted similarity are compared on full sets; each pair of blocks returns a
   forest of its links.  Components of the forests are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlay.llm.components import components
from coverlay.llm.forest import Forest
from coverlay.llm.words import WordTable, batches, mixed
from coverlay.operators.lineage import settle

#: Places of a signature, and the share of pairs at the threshold that bands may miss.
PLACES, MISSED = 256, 1e-5
# Elements signed at once (a shuffle of all places each), and columns of an indicator matrix.
SIGNED_ELEMENTS, COLUMNS = 50_000, 2048
#: Documents and shingles of a block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 300_000
#: What tells rows apart: the key, or 0 and ``none`` for a null key, and a digest of the text.
IDENTITY = ["key", "none", "digest"]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, by length, as one column."""
    out = np.empty((len(words), 1), np.uint64)
    groups: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        groups.setdefault(len(word), []).append(place)
    with np.errstate(over="ignore"):
        for length, places in groups.items():
            chars = np.frombuffer(b"".join([words[p] for p in places]), np.uint8).reshape(len(places), length).astype(np.uint64)
            value = np.full(len(places), 0x9E3779B97F4A7C15 + length, np.uint64)
            for column in range(length):
                value = (value ^ chars[:, column]) * np.uint64(0x100000001B3)
                value ^= value >> np.uint64(31)
            out[places, 0] = mixed(value)
    return out


class Shingler:
    """Sets of hashed shingles of texts; words are runs of anything but space and
    ``\\x09-\\x0D``, with A-Z in lower case.  Fewer words than a shingle are one shingle, no
    words none."""

    def __init__(self, size: int):
        self.size = size
        self._table = WordTable(word_hashes)

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """A sorted array without repeats per text."""
        for begin, end in batches(texts):
            # bytes.split() cuts at exactly the six ASCII blanks.
            split = [t.encode().lower().split() for t in texts[begin:end]]
            words = [w for s in split for w in s]
            hashes = self._table.rows(words)[:, 0] if words else np.zeros(0, np.uint64)
            at = 0
            for s in split:
                yield self._shingles(hashes[at : at + len(s)])
                at += len(s)

    def _shingles(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if not n:
            return np.zeros(0, np.uint64)
        width = min(self.size, n)
        with np.errstate(over="ignore"):
            value = np.full(n - width + 1, 0xC2B2AE3D27D4EB4F + width, np.uint64)
            for offset in range(width):
                value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + hashes[offset : offset + n - width + 1])
        return np.unique(value)


def superminhash(elements: np.ndarray, doc: np.ndarray, docs: int, places: int = PLACES) -> np.ndarray:
    """Signatures of ``docs`` sets: ``elements`` are hashes, ``doc`` their set's number.

    Numbers are kept as fixed-point: the step above 32 random bits.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full((docs, places), top, np.uint64)
    flat = signature.ravel()
    step = 0
    order = None
    while len(elements) and step < places:
        with np.errstate(over="ignore"):
            draw = mixed(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        offer = (np.uint64(step) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        # The place is the next of a Fisher-Yates shuffle that only the element decides.
        other = step + ((draw >> np.uint64(32)) * np.uint64(places - step) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            place = other
            first = other
        else:
            if order is None:
                order = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
                rows = np.arange(len(elements))
                order[rows, 0], order[rows, first] = order[rows, first], order[rows, 0].copy()
            rows = np.arange(len(elements))
            place = order[rows, other].astype(np.int64)
            order[rows, other] = order[rows, step]
            order[rows, step] = place
        np.minimum.at(flat, doc * places + place, offer)
        step += 1
        unfinished = signature.max(axis=1) >= (np.uint64(step) << np.uint64(32))
        stays = unfinished[doc]
        if not stays.all():
            elements, doc = elements[stays], doc[stays]
            if step == 1:
                first = first[stays]
            if order is not None:
                order = order[stays]
    return signature


def bands_for(threshold: float, places: int = PLACES, missed: float = MISSED) -> int:
    """Rows per band: the most that miss no more than the given share at the threshold."""
    fits = [r for r in range(1, places + 1) if (1 - threshold**r) ** (places // r) <= missed]
    return max(fits, default=1)


def _signer(shingle: int, rows: int):
    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle)
        for part in parts:
            sets = list(shingler.sets(part["text"].fillna("").tolist()))
            sizes = np.array([len(s) for s in sets], np.int64)
            prints, keys = np.zeros((len(sets), 2), np.int64), [None] * len(sets)
            begin = 0
            while begin < len(sets):
                # One set at least.
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), SIGNED_ELEMENTS)))
                some = sets[begin:end]
                elements = np.concatenate(some) if some else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(len(some)), sizes[begin:end])
                signature = superminhash(elements, doc, len(some))
                bands = signature[:, : signature.shape[1] // rows * rows].reshape(len(some), -1, rows)
                key = np.zeros(bands.shape[:2], np.uint64)
                with np.errstate(over="ignore"):
                    key += (np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(rows):
                        key = mixed(key * np.uint64(0x100000001B3) + bands[:, :, r])
                for i, s in enumerate(some):
                    if len(s):
                        prints[begin + i] = _print(s)
                        keys[begin + i] = key[i].view(np.int64)
                begin = end
            yield part[IDENTITY].assign(n=sizes, print1=prints[:, 0], print2=prints[:, 1], bands=keys)

    return sign


def _print(elements: np.ndarray) -> tuple[np.int64, np.int64]:
    """128 bits of a set: two sums of differently mixed elements."""
    with np.errstate(over="ignore"):
        a = mixed(elements + np.uint64(0x1234567)).sum(dtype=np.uint64)
        b = mixed(elements ^ np.uint64(0xABCDEF0123456789)).sum(dtype=np.uint64)
    return a.view(np.int64), b.view(np.int64)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections.  Elements of one set alone are left out; the rest are
    columns of two indicator matrices, multiplied some columns at a time."""
    elements = np.concatenate([*left, *right])
    doc = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    values, where, count = np.unique(elements, return_inverse=True, return_counts=True)
    shared = count[where] > 1
    number = np.cumsum(count > 1) - 1
    column, doc = number[where[shared]], doc[shared]
    by = np.argsort(column, kind="stable")
    column, doc = column[by], doc[by]
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        one = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        one[doc[a:b], column[a:b] - begin] = 1
        out += one[: len(left)] @ one[len(left) :].T
    return out.astype(np.int64)


def _comparer(percent: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found_a, found_b = [], []
        for _, group in rows.groupby("group_id", sort=True):
            group = group.sort_values("id", ignore_index=True)
            ids, n = group["id"].to_numpy(), group["n"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group["elements"]]
            sides = group["side"].to_numpy()
            left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
            both = overlaps([sets[i] for i in left], [sets[i] for i in right])
            union = n[left][:, None] + n[right][None, :] - both
            a, b = np.nonzero(100 * both >= percent * union)
            forest = Forest(ids)
            forest.join(ids[left][a], ids[right][b])
            child, parent = forest.edges()
            found_a.append(child)
            found_b.append(parent)
        return pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return compare


def _identified(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    number = F.col(key).cast("long")
    return {"key": F.coalesce(number, F.lit(0)), "none": number.isNull(), "digest": F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))}


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept``, one row per row of ``docs``.

    Documents link if ``100 * intersection >= percent * union`` of their shingle sets, which
    is confirmed on the full sets.  ``component_id`` is the smallest key reachable by links,
    ``kept`` marks one row that has it.  Null, empty and blank texts have no shingles and link
    with nothing; equal texts always link otherwise.  Keys are integers; rows of one key are
    documents of their own, and rows with a null key too, whose ``component_id`` is null if no
    row that they reach has a key.  An empty table gives no rows; other columns are not read.
    A pair at the threshold shares no band with probability ``MISSED`` at most, far less above
    it.
    """
    judged = _judged(docs, shingle, percent, key, text)
    return judged.select(F.when(~F.col("none"), F.col("key")).alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one of each component, and all
    without shingles.  Rows equal in key and text are one by a hash of their other columns."""
    found = _identified(docs, key, text)
    kept = _judged(docs, shingle, percent, key, text).filter("kept").select(*(F.col(c).alias(f"_{c}") for c in IDENTITY), (F.col("n") == 0).alias("_blank")).distinct()
    place = [f"_{c}" for c in IDENTITY]
    others = F.xxhash64(*(c for c in docs.columns if c not in (key, text)), F.lit(0))
    joined = docs.withColumns({f"_{c}": found[c] for c in IDENTITY}).join(kept, place)
    ranked = joined.withColumn("_rank", F.row_number().over(Window.partitionBy(*place).orderBy(others)))
    return ranked.filter((F.col("_rank") == 1) | F.col("_blank")).select(*docs.columns)


def _judged(docs: DataFrame, shingle: int, percent: int, key: str, text: str) -> DataFrame:
    """``key, none, digest, n, component_id, kept`` of every row."""
    rows = bands_for(percent / 100)
    found = _identified(docs, key, text)
    texts = docs.select(*(found[c].alias(c) for c in IDENTITY), F.col(text).alias("text"))
    prints = texts.mapInPandas(_signer(shingle, rows), "key long, none boolean, digest string, n long, print1 long, print2 long, bands array<long>")
    # From here on a row is its number, as keys may be null or repeated.
    signed = settle(prints.withColumn("id", F.monotonically_increasing_id()))
    same = ["n", "print1", "print2"]
    first = F.struct("none", "key", "digest", "id")
    distinct = signed.filter(F.col("n") > 0).groupBy(*same).agg(F.min(first).alias("first"))
    member = settle(signed.select("id", *IDENTITY, *same).join(distinct, same, "left").select("id", *IDENTITY, "n", F.col("first.id").alias("rep"), F.when(~F.col("first.none"), F.col("first.key")).alias("rep_key")))
    # Band keys of representatives alone.
    reps = member.filter(F.col("id") == F.col("rep")).select("id")
    bands = signed.select("id", F.explode("bands").alias("band")).join(reps, "id", "left_semi")
    smallest = bands.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("many")).filter(F.col("many") > 1)
    ties = bands.join(smallest.select("band", "least"), "band").filter(F.col("id") != F.col("least")).select(F.col("id").alias("a"), F.col("least").alias("b"))
    groups = components(ties.distinct()).select(F.col("node").alias("id"), F.col("component").alias("group_id"))

    # Blocks of a group: by size class, then by hash.  Classes a bit wider than the threshold
    # keep linked sets in the same or in neighbouring ones.
    sized = settle(groups.join(signed.select("id", *IDENTITY, *same), "id").withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100 * 0.99)).cast("int")))
    cuts = sized.groupBy("group_id", "size_class").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).withColumn(
        "parts", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    )
    above = cuts.select("group_id", (F.col("size_class") - 1).alias("size_class"), F.col("parts").alias("next_parts"))
    below = cuts.select("group_id", (F.col("size_class") + 1).alias("size_class"), F.col("parts").alias("last_parts"))
    known = cuts.select("group_id", "size_class", "parts").join(above, ["group_id", "size_class"], "left").join(below, ["group_id", "size_class"], "left")
    placed = sized.join(known, ["group_id", "size_class"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    unit = lambda low, a, b, step, side: F.struct(low.alias("low"), a.alias("i"), b.alias("j"), F.lit(step).alias("step"), side.alias("side"))
    part, size_class = F.col("part"), F.col("size_class")
    whole = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    units = F.concat(
        # Side 0 is compared with side 1, side 2 stands on both.
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: unit(size_class, F.least(p, part), F.greatest(p, part), 0, F.when(p == part, 2).when(part < p, 0).otherwise(1))),
        F.transform(whole(F.coalesce("next_parts", F.lit(0))), lambda p: unit(size_class, part, p, 1, F.lit(0))),
        F.transform(whole(F.coalesce("last_parts", F.lit(0))), lambda p: unit(size_class - 1, p, part, 1, F.lit(1))),
    )
    asked = placed.select("id", *same, "group_id", F.explode(units).alias("u")).select("id", *same, "group_id", "u.*")

    def spell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle)
        for part in parts:
            sets = list(shingler.sets(part["text"].tolist()))
            prints = np.array([_print(s) for s in sets], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"n": [len(s) for s in sets], "print1": prints[:, 0], "print2": prints[:, 1], "elements": [s.tobytes() for s in sets]})

    # One text per set: that of its representative, once if the row is repeated.
    chosen = texts.join(sized.select(*IDENTITY), IDENTITY, "left_semi").dropDuplicates(IDENTITY)
    spelled = chosen.select("text").mapInPandas(spell, "n long, print1 long, print2 long, elements binary")
    # Small groups share units, whose number follows the rows, so that few calls do the work.
    pair = F.struct("group_id", "low", "i", "j", "step")
    small = asked.join(cuts.groupBy("group_id").agg(F.sum("docs").alias("docs")), "group_id").withColumn(
        "bundle", F.when(F.col("docs") <= 32, F.pmod(F.xxhash64("group_id"), F.lit(_bundles(sized)))).otherwise(F.xxhash64(pair))
    )
    work = small.withColumn("compared", F.xxhash64(pair)).join(spelled, same)
    links = (
        work.select("bundle", F.col("compared").alias("group_id"), "id", "n", "side", "elements")
        .groupBy("bundle")
        .applyInPandas(_comparer(percent), "a long, b long")
    )
    linked = components(links)
    heads = linked.join(sized.select(F.col("id").alias("node"), first.alias("first")), "node").groupBy("component").agg(F.min("first").alias("head"))
    headed = linked.join(heads, "component").select(F.col("node").alias("rep"), F.col("head.id").alias("head"), F.when(~F.col("head.none"), F.col("head.key")).alias("head_key"))
    whole_key = F.when(F.col("head").isNotNull(), F.col("head_key")).when(F.col("rep").isNotNull(), F.col("rep_key")).when(~F.col("none"), F.col("key"))
    kept = F.col("id") == F.coalesce("head", "rep", "id")
    return member.join(headed, "rep", "left").select(*IDENTITY, "n", whole_key.alias("component_id"), kept.alias("kept"))


def _bundles(sized: DataFrame) -> int:
    """Bundles of about 500,000 shingles."""
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return max(1, total // 500_000)
