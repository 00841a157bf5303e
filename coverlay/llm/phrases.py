"""Phrase collocations, mined by partitioning (SON), one phrase length after another.

A shard is a bounded stretch of one language's text inside a task.  It is mined completely:
all its phrases of the length at hand are counted, and those that reach the support lowered
in proportion to the shard's share of the language's words are reported.  A phrase that is
frequent in all is frequent in at least one shard, so the reported phrases are all candidates
there can be; those are then counted over all shards, exactly.

Support 10 leaves 1 for a shard with less than a tenth of a language.  Such a shard withholds
nothing; if no shard did, the reported counts are the exact ones and nothing is counted again.
A phrase is looked at only if both its parts, one word shorter, may be frequent: a bit table
of bounded size says so, and what it passes wrongly is counted exactly and dropped.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlay.llm.words import mixed
from coverlay.operators.lineage import settle
from coverlay.operators.lookup import lookup

#: Text bytes of a shard, about; a piece without any separator may be longer.
SHARD_BYTES = 3_000_000
#: Largest bit table sent to the tasks, and bits per phrase below that.
MAX_BITS, BITS_EACH = 2**27, 32
#: Languages whose share lowers the support; in any other a shard reports all its phrases.
LANGUAGES = 1_000
#: Stands for the end of a piece; no UTF-8 text holds it.
END = b"\xff"
PIECE_BYTES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ROWS = "lang string, phrase string, n long, most long"


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, bytes]]:
    """A task's rows ``lang, text`` as stretches of text of one language, cut between pieces."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = (text.as_py() or b"").translate(PIECE_BYTES)
            begin = 0
            while len(body) - begin > shard_bytes and (cut := body.rfind(END, begin, begin + shard_bytes)) > begin:
                yield lang, body[begin:cut]
                begin = cut
            held[lang].append(body[begin:])
            size[lang] += len(body) - begin
            if size[lang] >= shard_bytes:
                yield lang, END.join(held.pop(lang))
                size.pop(lang)
        if sum(size.values()) >= 4 * shard_bytes:
            # Many languages at once: hand over all that is held.
            yield from ((name, END.join(held[name])) for name in held)
            held.clear()
            size.clear()
    yield from ((name, END.join(parts)) for name, parts in held.items())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def places(lang: str, hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit of each phrase, given its words' hashes, first words first."""
    place = np.full(len(hashes[0]), np.uint64(zlib.crc32(lang.encode()) + 1))
    for h in hashes:
        with np.errstate(over="ignore"):
            place = mixed(place * np.uint64(0x9E3779B97F4A7C15) + h)
    return place & np.uint64(bits - 1)


def _set(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def count_phrases(lang: str, text: bytes, length: int, parts: np.ndarray | None, own: np.ndarray | None) -> tuple[pa.Array, np.ndarray, int]:
    """Phrases of ``length`` words within pieces, their counts, and the number of all words.

    Only phrases whose two parts are set in ``parts`` and that are set in ``own``, if given.
    """
    words = text.replace(END, b" \xff ").split()
    index = {w: i for i, w in enumerate(dict.fromkeys([END, *words]))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    names = list(index)
    total = len(words) - int(np.count_nonzero(ids == 0))
    n = max(len(ids) - length + 1, 0)
    columns = [ids[k : k + n] for k in range(length)]
    inside = np.ones(n, bool)
    for c in columns:
        inside &= c > 0
    columns = [c[inside] for c in columns]
    # Numbers for the words so far, then one word more: below the square of the words held.
    key, stems = columns[0], None
    tails = []
    for c in columns[1:]:
        if stems is not None:
            stems, key = np.unique(key, return_inverse=True)
            tails.append(stems)
        else:
            stems = True
        key = key * len(names) + c
    found, counts = np.unique(key, return_counts=True)
    chosen = [found % len(names)]
    rest = found // len(names)
    for stems in reversed(tails):
        chosen.insert(0, stems[rest] % len(names))
        rest = stems[rest] // len(names)
    if length > 1:
        chosen.insert(0, rest)
    hashes = word_hashes(names)
    kept = np.ones(len(found), bool)
    if parts is not None and len(found):
        for piece in (chosen[:-1], chosen[1:]):
            kept &= _set(parts, places(lang, [hashes[c] for c in piece], 64 * len(parts)))
    if own is not None and len(found):
        kept &= _set(own, places(lang, [hashes[c] for c in chosen], 64 * len(own)))
    names[0] = b""
    spelt = pa.array(names, pa.large_binary())
    phrase = spelt.take(pa.array(chosen[0][kept]))
    for c in chosen[1:]:
        phrase = pc.binary_join_element_wise(phrase, spelt.take(pa.array(c[kept])), pa.scalar(b" ", pa.large_binary()))
    return phrase.cast(pa.large_string()).cast(pa.string()), counts[kept], total


def mine(docs: DataFrame, length: int, min_count: int, lowered=None, parts=None, own=None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What the shards report: ``lang, phrase, n``, and for each shard a row without phrase: its
    words, and in ``most`` how many phrases it withheld.

    ``lowered`` (broadcast) has the words of the languages whose support is lowered in
    proportion.  A shard of another language reports all its phrases; without ``lowered``
    every shard does, and ``most`` is its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = {} if lowered is None else lowered.value
        tables = [None if b is None else b.value for b in (parts, own)]
        for lang, text in shards(batches, shard_bytes):
            phrases, counts, words = count_phrases(lang, text, length, *tables)
            most = words if lowered is None else 0
            if lang in words_of:
                # Whole numbers: count / words of the shard >= min_count / words of all.
                frequent = counts >= -(-min_count * words // words_of[lang])
                most = int(len(counts) - frequent.sum())
                phrases, counts = phrases.filter(pa.array(frequent)), counts[frequent]
            for begin in range(0, len(counts), 100_000):
                some = counts[begin : begin + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), phrases.slice(begin, len(some)), pa.array(some, pa.int64()), pa.nulls(len(some), pa.int64())],
                    ["lang", "phrase", "n", "most"],
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.nulls(1, pa.string()), pa.array([words], pa.int64()), pa.array([most], pa.int64())], ["lang", "phrase", "n", "most"]
            )

    return docs.mapInArrow(run, ROWS)


def _bit_table(frequent: DataFrame):
    """A broadcast of bits in which every phrase of ``frequent`` is set."""
    spark = frequent.sparkSession
    bits = 64
    while bits < min(BITS_EACH * frequent.count(), MAX_BITS):
        bits *= 2

    @F.pandas_udf("long")
    def place(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        out = np.zeros(len(lang), np.int64)
        split = [p.encode().split(b" ") for p in phrase]
        for (name, length), rows in pd.DataFrame({"lang": lang.to_numpy(), "length": [len(s) for s in split]}).groupby(["lang", "length"]).indices.items():
            out[rows] = places(name, [word_hashes([split[i][k] for i in rows]) for k in range(length)], bits)
        return pd.Series(out)

    at = frequent.select(place("lang", "phrase").alias("at"))
    # A number of 64 bits per row, MAX_BITS / 64 rows at most.
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(table)


def frequent_phrases(docs: DataFrame, longest: int, min_count: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of every phrase of up to ``longest`` words that occurs at
    least ``min_count`` times, and ``lang, n``, the words of each language.

    ``docs`` has ``lang`` and ``text`` (binary), no nulls in ``lang``.
    """
    context = docs.sparkSession.sparkContext
    levels, totals, lowered, parts = [], None, None, None
    for length in range(1, longest + 1):
        mined = settle(_summed(mine(docs, length, min_count, lowered, parts, None, shard_bytes), min_count, lowered))
        shard_rows, found = mined.filter(F.col("phrase").isNull()), mined.filter(F.col("phrase").isNotNull())
        if length == 1:
            totals = shard_rows.select("lang", "n")
            # Languages with a shard of more than one part in min_count of their words.
            uneven = shard_rows.filter(F.col("most") * min_count > F.col("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
            lowered = context.broadcast(dict(uneven.select("lang", "n").collect()))
        elif not shard_rows.filter(F.col("most") > 0).isEmpty():
            # Some shard withheld phrases: count all candidates over all shards.
            candidates = _bit_table(found)
            found = settle(_summed(mine(docs, length, min_count, None, parts, candidates, shard_bytes), min_count)).filter(F.col("phrase").isNotNull())
        levels.append(found.select("lang", "phrase", F.lit(length).alias("words"), "n"))
        if length < longest:
            parts = _bit_table(found)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    return counts, totals


def _summed(mined: DataFrame, min_count: int, lowered=None) -> DataFrame:
    """Sums over the shards.  Where no shard withholds, they are exact, and phrases that miss
    ``min_count`` go; candidates of the languages in ``lowered`` stay."""
    summed = mined.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    stay = F.col("phrase").isNull() | (F.col("n") >= min_count)
    return summed.filter(stay | F.col("lang").isin(list(lowered.value)) if lowered is not None else stay)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, min_count: int = 10, contained_percent: int = 50, k: int = 2_000, unknown: str = "und", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``k`` best phrases.

    Texts in lower case (A-Z) are split at ``.,;:!?`` and line ends into pieces, those at
    blanks and tabs into words.  ``a`` counts a phrase of 2 to ``longest`` words, ``n`` the
    language's words; the score ``10^6 a a div (l r)`` is that of the cut of the phrase into
    two that scores least, the earliest of equal ones.  Phrases inside a longer one that
    occurs ``contained_percent`` as often, or more, are dropped.  Ties: more occurrences, then
    the phrase in byte order.  Rows are counted as they are, repeated ones too; a null
    language is ``unknown``; null and empty texts have no words; no rows give no rows.  Other
    columns are not read.

    Counts are summed map-side, so a common phrase is a row per shard; parts of phrases that
    make up much of all words are looked up by broadcast, a bounded number.
    """
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(unknown)).alias("lang"), F.col(text).cast("binary").alias("text"))
    counts, totals = frequent_phrases(source, longest, min_count, shard_bytes)
    words = F.split("phrase", " ")
    size = F.size("words")
    candidates = counts.filter(F.col("words") > 1).select("lang", "phrase", words.alias("words"), F.col("n").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    halves = cuts.select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("cut") + 1, size), " ").alias("rest"),
    )
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = counts.select("lang", "phrase", "n")
    for name, count in (("first", "l"), ("rest", "r")):
        side = parts.select("lang", F.col("phrase").alias(name), F.col("n"))
        halves = lookup(halves, side, ["lang", name], "n", total, "found", ["phrase", "cut"]).withColumn(count, F.col("found.n")).drop("found")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    square = (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    scored = halves.withColumns({"over": square.cast("decimal(38,0)"), "under": (whole("l") * whole("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("over div under"))
    least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # Each candidate tells the phrases inside it how often it occurs.
    spans = [(at, n) for n in range(2, longest) for at in range(longest - n + 1)]
    inner = F.filter(F.array(*[F.when(F.lit(at + n) <= size, F.when(F.lit(n) < size, F.array_join(F.slice("words", at + 1, n), " "))) for at, n in spans]), lambda p: p.isNotNull()) if spans else F.array().cast("array<string>")
    longer = candidates.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
