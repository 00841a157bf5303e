"""Key-set comparisons, each one pass over the keys with a single shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.operators.ordering import top_per_group


def presence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key with ``in_left`` / ``in_right``."""
    sides = left.select(*keys, F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select(*keys, F.lit(False).alias("l"), F.lit(True).alias("r"))
    )
    return sides.groupBy(*keys).agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))


def reconcile(package: DataFrame, scored: DataFrame, key: str, by: str, sample: int = 10) -> DataFrame:
    """Per group: key counts on both sides, differences each way, and a few of them."""
    keys = presence(package, scored, [by, key])
    counts = keys.groupBy(by).agg(
        F.count_if("in_left").alias("package_count"),
        F.count_if("in_right").alias("scored_count"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("extra_count"),
        F.count_if(~F.col("in_left") & F.col("in_right")).alias("missing_count"),
    )
    odd = keys.filter(F.col("in_left") != F.col("in_right"))
    few = top_per_group(odd, [by, "in_left"], [F.col(key)], sample)
    samples = few.groupBy(by).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("in_left"), F.col(key)))), ";").alias("extra_sample"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("in_left"), F.col(key)))), ";").alias("missing_sample"),
    )
    blank = F.lit("")
    return counts.join(samples, by, "left").withColumns(
        {n: F.coalesce(n, blank) for n in ("extra_sample", "missing_sample")}
    )


def shared_across(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in more than one group, with the groups' names."""
    return (
        df.select(key, group)
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_groups"), F.array_join(F.array_sort(F.collect_list(group)), ";").alias("groups"))
        .filter(F.col("n_groups") > 1)
    )


def value_set_difference(wide: DataFrame, narrow: DataFrame, value: str, by: str) -> DataFrame:
    """Distinct values present on one side only, per group, and whether the sets agree.

    Arrays hold distinct category values, a small vocabulary by nature.
    """
    keys = presence(wide.filter(F.col(value).isNotNull()), narrow.filter(F.col(value).isNotNull()), [by, value])

    def only(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col(value)))), ";")

    left_only = F.col("in_left") & ~F.col("in_right")
    right_only = ~F.col("in_left") & F.col("in_right")
    return keys.groupBy(by).agg(
        only(left_only).alias("only_in_unfiltered"),
        only(right_only).alias("only_in_filtered"),
        (F.count_if(left_only | right_only) == 0).alias("identical"),
    )


def common_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys found on both sides."""
    return left.select(*keys).intersect(right.select(*keys))


def missing_keys(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys with no match: empty when a lookup lost nothing."""
    return expected.join(found.select(*keys), list(keys), "left_anti")


def union_scopes(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column absent from one is NULL there."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked
