"""Exact order statistics that never sort a whole group in one task.

Values are counted first (equal values collapse map-side), distinct counts are bucketed by
value range, and running totals are formed inside each bucket and across the few bucket
totals.  A group with a third of all rows is therefore still split by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlay.functions.values import number
from coverlay.operators.lookup import lookup

# Fewest value ranges; sessions with more shuffle partitions get as many ranges as those.
BUCKETS = 64


def _cuts_below(value: Column, cuts: Column, buckets: int) -> Column:
    """Number of sorted ``cuts`` below ``value``: binary search, a step for each power of two."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(buckets.bit_length()))])
    below = lambda at, step: F.try_element_at(cuts, at + step) < value
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct non-null value: ``n``, rows ``before`` it and the group's ``total``."""
    by = list(by)
    data = df.select(*by, number(value).alias("value")).filter(F.col("value").isNotNull())
    counted = data.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    # Approximate cuts only steer the bucketing (a sketch per task, no shuffle).
    buckets = max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = data.agg(F.percentile_approx("value", shares, 10 * buckets)).scalar()
    bucketed = counted.withColumn("cuts", cuts).select(
        *by, "value", "n", _cuts_below(F.col("value"), F.col("cuts"), buckets).alias("bucket")
    )
    group = by or [F.lit(0)]
    sizes = bucketed.groupBy(*by, "bucket").agg(F.sum("n").alias("rows"))
    in_order = Window.partitionBy(*group).orderBy("bucket")
    bases = sizes.select(
        *by,
        "bucket",
        (F.sum("rows").over(in_order) - F.col("rows")).alias("base"),
        F.sum("rows").over(Window.partitionBy(*group)).alias("total"),
    )
    within = Window.partitionBy(*by, "bucket").orderBy("value")
    running = bucketed.withColumn("before", F.sum("n").over(within) - F.col("n"))
    return running.join(bases, [*by, "bucket"]).select(
        *by, "value", "n", (F.col("before") + F.col("base")).alias("before"), "total"
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles per group, named by ``probabilities``."""
    ranked = cumulative_counts(df, value, by)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))

    wanted = []
    for name, p in probabilities.items():
        rank = (F.col("total") - 1) * F.lit(float(p))
        low, high, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        wanted.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*wanted)


def average_ranks(df: DataFrame, names: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Ascending rank of each value column, ties sharing their mean rank; NULL stays NULL.

    ``names`` maps value columns to rank columns.  Every rank table comes from ``df`` itself,
    so ranking several columns does not repeat the work of the earlier ones.  Values that make
    up much of all rows find their rank by broadcast, a bounded number of them, and NULLs have
    none to find: both stay spread over all tasks.
    """
    by, out = list(by), df
    for value, name in names.items():
        ranked = cumulative_counts(df, value, by)
        total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
        table = ranked.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("value").alias("_value"), "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
        keyed = out.select(F.struct(*out.columns).alias("_row"), *[F.col(c).alias(f"_by_{c}") for c in by], number(value).alias("_value"))
        found = lookup(keyed, table, [*[f"_by_{c}" for c in by], "_value"], "n", total, "_found", ["_row"])
        out = found.select(*[F.col("_row").getField(c).alias(c) for c in out.columns], F.col("_found.rank").alias(name))
    return out


def median_split(df: DataFrame, value: str, covered: str, by: str, name: str) -> DataFrame:
    """``value >= median of the group's covered rows``; NULL where not covered or missing."""
    usable = F.when(F.coalesce(F.col(covered), F.lit(False)), number(value))
    masked = df.withColumn("_usable", usable)
    medians = exact_quantiles(masked, "_usable", {"_median": 0.5}, [by])
    return masked.join(medians, by, "left").withColumn(name, F.col("_usable") >= F.col("_median")).select(*df.columns, name)


def histogram(df: DataFrame, value: str, by: str, bins: int = 40, cap: float | None = None) -> DataFrame:
    """Equal-width bins between each group's minimum and maximum, last bin closed.

    ``cap`` first lowers values above that quantile to it.  Empty bins are not listed.
    """
    data = df.select(F.col(by), number(value).alias("value")).filter(F.col("value").isNotNull())
    if cap is not None:
        tops = exact_quantiles(data, "value", {"top": cap}, [by])
        data = data.join(tops, by, "left").select(by, F.least("value", "top").alias("value"))
    limits = data.groupBy(by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = data.join(limits, by, "left")
    width = (F.col("high") - F.col("low")) / bins
    raw = F.when(width > 0, F.floor((F.col("value") - F.col("low")) / width)).otherwise(F.lit(0))
    bucket = F.least(raw, F.lit(bins - 1)).cast("int")
    return placed.groupBy(by, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark limits each partition before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
