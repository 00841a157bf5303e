"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt to logical partitions by a hash of their key.  How many rows each partition
sends to each shard is drawn first, from the law that a uniform shuffle of all rows would
give (a multivariate hypergeometric matrix with fixed row and column sums); then each
partition permutes its rows, cuts them at the drawn counts, and each shard permutes again.

The matrix is drawn by halving: the shard counts of a block of partitions are split between
its two halves, level by level, each level an ordinary narrow projection; after the first
levels the blocks are spread over tasks.  Small draws invert the law on its few likely
values, wide ones reject from a ratio of uniforms, so a draw costs the same at any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlay.llm.columns import uniform
from coverlay.operators.lineage import settle

#: Rows of a logical partition, about; each is one window group.
PARTITION_ROWS = 20_000
#: Partitions are two to this power at least.
LEAST_LEVELS = 3
#: Standard deviations on either side of the mean that a small draw considers (misses under 1e-20).
REACH = 10.0
#: Draws of more than this standard deviation are made by rejection.
WIDE = 6.0
#: Tries of a rejection, each accepted with a chance above 0.6; the mode counts after the last.
TRIES = 60


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _log_factorial(n: Column) -> Column:
    """Logarithm of ``n!`` for whole ``n`` from 0, by Stirling's series; small ones by sum."""
    small = F.element_at(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16))), F.least(n, F.lit(15)).cast("int") + 1)
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x
    return F.when(n < 16, small).otherwise(series)


def _inverted(n: Column, k: Column, d: Column, low: Column, high: Column, u: Column) -> Column:
    """The value at ``u`` on the support from ``low`` to ``high``, weights by the ratio of neighbours."""
    n, k, d = (c.cast("double") for c in (n, k, d))

    def heavier(weight: Column, x: Column) -> Column:
        xd = x.cast("double")
        return weight * (k - xd) * (d - xd) / ((xd + 1) * (n - k - d + xd + 1))

    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))

    def add(state: Column, x: Column) -> Column:
        return _let(heavier(state["w"], x), lambda w: F.struct(w.alias("w"), (state["sum"] + w).alias("sum")))

    def climb(goal: Column) -> Column:
        walk = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), F.lit(0).cast("long").alias("up"))
        one = lambda s, x: _let(
            heavier(s["w"], x),
            lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), (s["up"] + F.when(s["sum"] <= goal, 1).otherwise(0)).alias("up")),
        )
        return F.aggregate(steps, walk, one, lambda s: s["up"])

    return low + _let(u * F.aggregate(steps, start, add, lambda s: s["sum"]), climb)


def _rejected(n: Column, k: Column, d: Column, low: Column, high: Column, spread: Column, u: Column) -> Column:
    """A draw by the ratio of uniforms: a point of a box that covers the law's root, accepted under it."""
    mode = F.floor((d.cast("double") + 1) * (k.cast("double") + 1) / (n.cast("double") + 2)).cast("long")

    def log_weight(x: Column) -> Column:
        return -(_log_factorial(x) + _log_factorial(k - x) + _log_factorial(d - x) + _log_factorial(n - k - d + x))

    def draw(top: Column) -> Column:
        def attempt(done: Column, turn: Column) -> Column:
            v, w = uniform(u, turn, 1) + 2.0**-54, uniform(u, turn, 2)

            def judge(v: Column) -> Column:
                x = F.floor(mode + 0.5 + (w - 0.5) * 2 * (1.2 * spread + 1.5) / v).cast("long")
                return _let(
                    x,
                    lambda x: F.when((x >= low) & (x <= high), F.when(2 * F.ln(v) <= log_weight(x) - top, x)),
                )

            return F.when(done.isNotNull(), done).otherwise(_let(v, judge))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), attempt)
        return F.coalesce(found, mode)

    return _let(log_weight(mode), draw)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are hit by ``draws`` without replacement.

    A function of ``u``, a uniform number: by inversion where the law is narrow, by rejection
    with numbers hashed from ``u`` where it is wide.
    """
    n, k, d = (c.cast("double") for c in (total, good, draws))
    share = F.when(n > 0, k / n).otherwise(0.0)
    deviation = F.sqrt(F.greatest(d * share * (1 - share) * F.when(n > 1, (n - d) / (n - 1)).otherwise(0.0), F.lit(0.0)))
    least, most = F.greatest(F.lit(0).cast("long"), draws - (total - good)), F.least(draws, good)

    def choose(given: Column) -> Column:
        spread, mean = given["spread"], given["mean"]
        low = F.greatest(given["least"], F.floor(mean - REACH * spread - REACH))
        high = F.least(given["most"], F.ceil(mean + REACH * spread + REACH))
        narrow = _inverted(total, good, draws, low, high, given["u"])
        return F.when(spread <= WIDE, narrow).otherwise(_rejected(total, good, draws, given["least"], given["most"], spread, given["u"]))

    return _let(F.struct(deviation.alias("spread"), (d * share).alias("mean"), least.alias("least"), most.alias("most"), u.alias("u")), choose)


def _left_counts(seed: int) -> Column:
    """Shard counts of the left half of a node, one shard after the other."""
    start = F.struct(
        F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
        F.aggregate("left_rows", F.lit(0).cast("long"), lambda s, x: s + x).alias("draws"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def deal(state: Column, good: Column) -> Column:
        u = uniform(seed, F.col("level"), F.col("node"), F.size(state["out"]))
        x = _let(good, lambda good: hypergeometric(state["total"], good, state["draws"], u))
        return _let(
            x,
            lambda hit: F.struct(
                (state["total"] - good).alias("total"), (state["draws"] - hit).alias("draws"), F.concat(state["out"], F.array(hit)).alias("out")
            ),
        )

    return F.aggregate("counts", start, deal, lambda s: s["out"])


def communication_matrix(sizes: DataFrame, levels: int, shards: int, seed: int = 0) -> DataFrame:
    """``part, counts``: rows that each of ``2 ** levels`` partitions sends to each shard.

    ``sizes`` holds ``part, n`` for the partitions that have rows; the sums over partitions
    are the shards' exact sizes, at most one apart.
    """
    parts = 2**levels
    every = sizes.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")).join(sizes, "part", "left")
    listed = F.array_sort(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).cast("long").alias("n"))))
    root = every.agg(listed.alias("listed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(
        F.lit(0).cast("long").alias("node"),
        F.transform("listed", lambda p: p["n"]).alias("rows"),
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.floor((F.col("total") - s + shards - 1) / F.lit(shards)).cast("long"),
        ).alias("counts"),
    )
    # One expression for all levels: building it takes longer than a level's draws.
    level, left_counts = root, _left_counts(seed)
    for depth in range(levels):
        half = parts >> (depth + 1)
        if depth == levels // 2:
            # The upper half of the tree is small; its blocks go on in several tasks.
            level = level.repartition(2 ** max(depth - 2, 0), "node")
        level = (
            level.withColumns(
                {"level": F.lit(depth), "left_rows": F.slice("rows", 1, half), "right_rows": F.slice("rows", half + 1, half)}
            )
            .withColumn("left_counts", left_counts)
            .select(
                F.explode(
                    F.array(
                        F.struct((F.col("node") * 2).alias("node"), F.col("left_rows").alias("rows"), F.col("left_counts").alias("counts")),
                        F.struct(
                            (F.col("node") * 2 + 1).alias("node"),
                            F.col("right_rows").alias("rows"),
                            F.zip_with("counts", "left_counts", lambda c, x: c - x).alias("counts"),
                        ),
                    )
                ).alias("half")
            )
            .select("half.*")
        )
    return level.select(F.col("node").cast("int").alias("part"), "counts")


def shuffle_into_shards(df: DataFrame, key: list[str], shards: int = 16, seed: int = 0) -> DataFrame:
    """Every row with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in it).

    The order is a uniform shuffle decided by the seed, the number of rows and the ``key``
    columns alone, so reruns, retried tasks and sessions of any settings agree.  Shard sizes differ by at most one.  Rows equal in all
    key columns are interchangeable: each gets a slot, which of them gets which is open.
    Nulls in the key are values like others.  An empty table gives no rows.  The columns
    ``shard`` and ``slot`` must not exist; others may have any name.
    """
    clash = {"shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    # Names of our own, so that no column of the rows is in the way.
    inner = {c: f"in{i}" for i, c in enumerate(df.columns)}
    names, key = list(inner.values()), [inner[k] for k in key]
    held = settle(df.toDF(*names))
    levels = max(LEAST_LEVELS, math.ceil(math.log2(max(held.count() / PARTITION_ROWS, 1))))
    dealt = held.withColumns({"part": F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2**levels)).cast("int"), "first": F.xxhash64(F.lit(seed + 1), *key)})
    matrix = settle(communication_matrix(dealt.groupBy("part").agg(F.count("*").alias("n")), levels, shards, seed))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("first", *key)))
    cuts = matrix.select(
        "part",
        F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x)).alias("cuts"),
    )
    sent = ranked.join(cuts, "part").withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))))
    # The second permutation: a random number in each shard, ranked piece by piece.
    mixed = sent.withColumn("second", F.xxhash64(F.lit(seed + 2), *key)).withColumn("piece", F.shiftright("second", 64 - levels).cast("long"))
    by_shard = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = mixed.groupBy("shard", "piece").agg(F.count("*").alias("n")).select(
        "shard", "piece", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("second", *key))
    placed = mixed.withColumn("inside", inside).join(starts, ["shard", "piece"])
    own = [F.col(c).alias(name) for name, c in inner.items()]
    return placed.select(*own, "shard", (F.col("start") + F.col("inside") - 1).alias("slot"))
