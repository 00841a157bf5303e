"""Mixing sources to target weights, word block by word block.

1. The words of a source, document after document, are packed into blocks of fixed length;
   a source of few words has shorter ones, so that a block is a small part of any source.
2. Targets come from the weights: a total is shared out by weight, no source above a
   multiple of its size, what it can't take going to the others.
3. Each output shard draws, slot by slot, which source fills the slot: its source counts are
   multinomial.  Draws of a source beyond its target pass to sources that were drawn too
   seldom, so that the totals are the targets.
4. The n-th slot of a source takes the block at place n of a pseudorandom permutation of the
   source's blocks, a new permutation for each pass, and is joined to it by block index.

Every draw is a hash of a seed and positions, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlay.llm.columns import uniform
from coverlay.operators.lineage import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket, about, within which offsets are running sums.
BUCKET_ROWS = 20_000
#: Blocks that a source has at least, if it has as many words.
SOURCE_BLOCKS = 256
#: Rounds of the index permutation.
ROUNDS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, docs, words, source_no, target`` from ``source, docs, words``.

    Sources in code point order, null last, take the weights in turn.  ``share`` times all
    words go out by weight; a target stops at ``most`` times the source's words and the
    excess is shared again.  The end of that process is ``min(most * words, level * weight)``
    for one level, which is found by running sums over the sources in the order in which
    they fill up.  One row per source: the windows are over that catalogue.
    """
    weight_list = F.array(*[F.lit(float(w)) for w in weights])
    catalogue = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("_full", "source_no")
    known = sizes.withColumn("source_no", F.row_number().over(catalogue) - 1).withColumn(
        "_weight", F.element_at(weight_list, F.col("source_no") % len(weights) + 1)
    )
    cap = F.col("words") * F.lit(float(most))
    ordered = known.withColumn("_full", cap / F.col("_weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("words").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ordered.withColumn("_level", level)
    reached = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "source_no", "_level"))).over(everything)["_level"]
    target = F.when(reached.isNull(), cap).otherwise(F.least(cap, reached * F.col("_weight")))
    return levels.withColumn("target", target).select("source", "docs", "words", "source_no", "target")


@dataclass(frozen=True)
class Mix:
    """``sources``: one row per source.  ``slots``: ``shard, place, source_no, epoch, block``.
    ``pieces``: ``source_no, block, key, start, text_hash, begin, words``: which words of which
    row a block holds.
    ``rows``: the input's rows with ``source_no, size, start``; ``source_no, start`` identify
    a row that has words.
    """

    sources: DataFrame
    rows: DataFrame
    pieces: DataFrame
    slots: DataFrame

    def taken(self) -> DataFrame:
        """``source_no, start, taken``: words of each row that has words, repeats counted."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        parts = self.pieces.join(times.hint("merge"), ["source_no", "block"], "left")
        return parts.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))


def _permuted(index: Column, size: Column, *seed: Column | int) -> Column:
    """A pseudorandom permutation of ``0 .. size - 1``: a swap-or-not network over any size.

    In each round an index and its mirror image about a random point swap places or stay, as
    a hash of the larger of the two says.
    """
    modulus = F.greatest(size, F.lit(1))

    def swap(x: Column, turn: Column) -> Column:
        point = F.pmod(F.xxhash64(F.lit(17), turn, *[s if isinstance(s, Column) else F.lit(s) for s in seed]), modulus)
        mirror = F.pmod(point - x, modulus)
        coin = F.xxhash64(F.lit(23), turn, F.greatest(x, mirror), *[s if isinstance(s, Column) else F.lit(s) for s in seed])
        return F.when(F.bitwise_not(coin).bitwiseAND(1) == 0, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), index.cast("long"), swap)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64, shard_slots: int = 16_384, seed: int = 0) -> Mix:
    """Plan a mix of all rows; see the module's text for the method.

    Words are runs of anything but space and ``\\x09-\\x0D``; null and empty texts have none,
    their rows stay in ``rows`` with size 0 and are in no piece.  Rows with equal keys are
    rows like others.  An empty table, or one without words, gives no slots.  A source's
    taken words differ from its target by a few blocks at most, a block being ``block_words``
    words or a 256th of the source if that is less, and as no block is taken more than ``ceil(most)`` times, no row exceeds that multiple of its size.  Other columns
    of ``docs`` are not read.
    """
    sized = settle(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _row_hash(key, source, text).alias("text_hash"))
    )
    totals = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    length = F.greatest(F.least(F.lit(block_words), F.floor(F.col("words") / SOURCE_BLOCKS)), F.lit(1)).cast("long")
    blocks = F.ceil(F.col("words") / F.col("block_words")).cast("long")
    quota = F.when(F.col("words") > 0, F.round(F.col("target") / F.col("words") * F.col("blocks"))).otherwise(0).cast("long")
    sources = settle(
        source_targets(totals, weights, share, most)
        .withColumn("block_words", length)
        .withColumn("blocks", blocks)
        .withColumn("quota", quota)
        .withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS).cast("long"))
    )

    # Where each row's words start in its source: bucket totals, then running sums inside.
    numbers = sources.select("source", "source_no", "buckets", "block_words")
    bucketed = (
        sized.join(numbers, sized["source"].eqNullSafe(numbers["source"]))
        .select("key", sized["source"], "source_no", "size", "text_hash", "block_words", F.pmod(F.xxhash64(F.lit(seed), "text_hash"), "buckets").alias("bucket"))
    )
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select(
        "source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source_no", "bucket").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = settle(
        bucketed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["source_no", "bucket"])
        .select("key", "source", "source_no", "size", "text_hash", "block_words", (F.col("offset") + F.col("ahead")).alias("start"))
    )
    end = F.col("start") + F.col("size")
    pieces = (
        rows.filter(F.col("size") > 0)
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((end - 1) / F.col("block_words")))))
        .withColumn("begin", F.greatest(F.col("start"), F.col("block") * F.col("block_words")))
        .select(
            "source_no", "block", "key", "start", "text_hash",
            (F.col("begin") - F.col("start")).alias("begin"),
            (F.least(end, (F.col("block") + 1) * F.col("block_words")) - F.col("begin")).alias("words"),
        )
    )
    return Mix(sources, rows, pieces, _slots(sources, shard_slots, seed))


def _row_hash(key: str, source: str, text: str) -> Column:
    return F.xxhash64(key, source, text)


def mixed_texts(docs: DataFrame, planned: Mix, key: str = "doc_id", source: str = "source", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The mix as rows of ``docs``: for each pass over a source, a row for each run of
    adjacent blocks that holds words of a document, ``text`` being these words as they stand
    there and ``length``, if there is such a column, their characters.

    A document taken whole is one row as it was.  Documents without words are in no block.
    The list that is put together per row is that of one document's blocks; each text is split
    once.  Of rows equal in key, source and text, all are taken from as one of them stands,
    also where they differ in other columns.
    """
    held = planned.pieces.join(planned.slots.select("source_no", "block", "epoch").hint("merge"), ["source_no", "block"])
    ordered = F.array_sort(F.collect_list(F.struct("begin", "words")))
    per_pass = held.groupBy("source_no", "start", "epoch").agg(F.first("text_hash").alias("hash"), F.first("key").alias("key"), ordered.alias("parts"))

    def extend(runs: Column, part: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        joins = (F.size(runs) > 0) & (last["begin"] + last["words"] == part["begin"])
        longer = F.struct(last["begin"].alias("begin"), (last["words"] + part["words"]).alias("words"))
        return F.when(joins, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(part)))

    none = F.array().cast("array<struct<begin:bigint,words:bigint>>")
    runs = per_pass.select("source_no", "start", "hash", "key", F.aggregate("parts", none, extend).alias("runs"))
    per_row = runs.groupBy("source_no", "start").agg(F.first("hash").alias("hash"), F.first("key").alias("key"), F.flatten(F.collect_list("runs")).alias("runs"))
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("own"), _row_hash(key, source, text).alias("own_hash"))
    found = texts.dropDuplicates(["own_hash", "own"]).join(per_row.hint("merge"), (F.col("own_hash") == F.col("hash")) & F.col("own").eqNullSafe(F.col("key")))
    pattern = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    split = found.select("row", "runs", F.regexp_extract_all(F.col("row")[text], F.lit(pattern), F.lit(0)).alias("words"))
    cuts = F.transform("runs", lambda r: F.array_join(F.slice("words", (r["begin"] + 1).cast("int"), r["words"].cast("int")), ""))
    cut = split.select("row", F.explode(cuts).alias("cut"))
    changed = {text: F.col("cut")}
    if length in docs.columns:
        changed[length] = F.length("cut").cast(docs.schema[length].dataType)
    return cut.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def _slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    shards = -(-total // shard_slots)
    ahead = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = sources.select("source_no", (F.sum("quota").over(ahead) / F.lit(float(max(total, 1)))).alias("edge"))
    # The catalogue's cumulative shares, one array; a draw is the first edge above a random number.
    shares = edges.agg(F.sort_array(F.collect_list(F.struct("source_no", "edge"))).alias("edges")).scalar()
    width = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots)
    owners = F.transform(
        F.sequence(F.lit(0).cast("long"), width - 1),
        lambda i: F.coalesce(
            F.filter(F.col("edges"), lambda e: e["edge"] > uniform(seed + 1, F.col("shard"), i))[0]["source_no"],
            F.element_at("edges", -1)["source_no"],
        ),
    )
    cuts = spark.range(0, shards, 1, max(1, min(shards, 4096))).withColumnRenamed("id", "shard")
    # A shard's draws are one array: small to keep, and drawn once.
    drawn_shards = settle(cuts.withColumn("edges", shares).select("shard", owners.alias("owners")))
    draws = drawn_shards.select("shard", F.posexplode("owners").alias("place", "source_no"))

    # Draws beyond a source's quota go to the sources that lack some, matched by number.
    counts = settle(draws.groupBy("shard", "source_no").agg(F.count("*").alias("n")))
    drawn = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    balance = settle(
        sources.join(drawn, "source_no", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
        .withColumn("lack", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
        .select(
            "source_no", "blocks", "quota", "drawn", "lack",
            F.coalesce(F.sum("over").over(upto), F.lit(0)).alias("over_from"),
            F.coalesce(F.sum("lack").over(upto), F.lit(0)).alias("lack_from"),
        )
    )
    # The ordinal of each draw within its source.  Spark takes exploded ranges for small, so
    # joins of slots name their strategy: none of their sides is to be broadcast unmeasured.
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(balance.select("source_no", "blocks", "quota", "over_from").hint("merge"), "source_no")
        .drop("n")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "source_no").orderBy("place")) - 1
    placed = draws.withColumn("inside", inside).join(starts.hint("merge"), ["shard", "source_no"]).withColumn("nth", F.col("ahead") + F.col("inside"))
    kept = placed.filter(F.col("nth") < F.col("quota")).select("shard", "place", "source_no", "nth", "blocks")
    gaps = balance.filter(F.col("lack") > 0).select(
        "source_no", "blocks", "drawn", "lack_from", F.explode(F.sequence(F.col("lack_from"), F.col("lack_from") + F.col("lack") - 1)).alias("match")
    )
    spare = placed.filter(F.col("nth") >= F.col("quota")).select("shard", "place", (F.col("over_from") + F.col("nth") - F.col("quota")).alias("match"))
    moved = spare.join(gaps.hint("merge"), "match").select("shard", "place", "source_no", (F.col("drawn") + F.col("match") - F.col("lack_from")).alias("nth"), "blocks")
    epoch = F.floor(F.col("nth") / F.col("blocks"))
    return kept.unionByName(moved).select(
        "shard", "place", "source_no", epoch.alias("epoch"),
        _permuted(F.col("nth") % F.col("blocks"), F.col("blocks"), seed + 2, F.col("source_no"), epoch).alias("block"),
    )
