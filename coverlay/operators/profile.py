"""Column profiles, null-pattern checks and value distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from coverlay.functions.gaps import all_null
from coverlay.functions.values import count_where, number
from coverlay.operators.ordering import top_per_group

# Numbers that often stand for "missing", and the share that makes one suspect.
SENTINELS = (-1.0, -999.0, -9999.0, 9999.0, 99999.0)
SENTINEL_MIN_SHARE = 0.01
NATIONAL = "national"


def _cells(df: DataFrame, columns: Sequence[str], scope: Column) -> DataFrame:
    """Long form ``region, column_name, value, number``; NaN counts as missing."""
    items = []
    for name in columns:
        numeric = isinstance(df.schema[name].dataType, NumericType)
        value = number(name) if numeric else F.col(name)
        items.append(
            F.struct(
                F.lit(name).alias("column_name"),
                value.cast("string").alias("value"),
                (value if numeric else F.lit(None)).cast("double").alias("number"),
            )
        )
    return df.select(scope.alias("region"), F.inline(F.array(*items)))


def null_profile(df: DataFrame, columns: Sequence[str], region: Column) -> DataFrame:
    """One row per (scope, column): rows, nulls, distinct values, min, max, mean, sentinels.

    Scopes are every region plus the whole table.  Values are counted once per region and
    the counts rolled up, so exact distinct counts for all columns take one scan.
    """
    counted = _cells(df, columns, region).groupBy("region", "column_name", "value", "number").agg(
        F.count(F.lit(1)).alias("n")
    )
    scopes = F.explode(F.array_compact(F.array(F.lit(NATIONAL), F.col("region"))))
    merged = (
        counted.withColumn("scope", scopes)
        .groupBy("scope", "column_name", "value", "number")
        .agg(F.sum("n").alias("n"))
    )
    filled = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    sentinel_counts = [
        F.sum(F.when(F.col("number") == s, F.col("n")).otherwise(0)).alias(f"s{i}") for i, s in enumerate(SENTINELS)
    ]
    stats = merged.groupBy("scope", "column_name").agg(
        F.sum("n").alias("n_rows"),
        filled.alias("filled"),
        F.count("value").alias("n_distinct"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.sum(F.col("number") * F.col("n")).alias("total"),
        *sentinel_counts,
    )
    notes = [
        F.when(
            (F.col("filled") > 0) & (F.col(f"s{i}") >= SENTINEL_MIN_SHARE * F.col("filled")),
            F.format_string(f"{s!r} in %.1f%% of non-null rows", 100.0 * F.col(f"s{i}") / F.col("filled")),
        )
        for i, s in enumerate(SENTINELS)
    ]
    joined = F.concat_ws("; ", *notes)
    return stats.select(
        "scope",
        "column_name",
        "n_rows",
        (F.col("n_rows") - F.col("filled")).alias("n_null"),
        ((F.col("n_rows") - F.col("filled")) / F.col("n_rows")).alias("pct_null"),
        "n_distinct",
        "min",
        "max",
        F.when(F.col("min").isNotNull(), F.col("total") / F.col("filled")).alias("mean"),
        F.when(joined != "", F.concat(F.lit("possible coded-missing sentinel(s): "), joined)).alias("sentinel_note"),
    )


def flag_groups(catalog: DataFrame, suffix: str = "_covered") -> DataFrame:
    """Which columns each coverage flag explains: ``flag_column, member_column``.

    A table with one flag gives it all its other columns; with several, each takes the
    columns sharing its prefix.  Flags are never members.
    """
    flags = catalog.filter(F.col("column_name").endswith(suffix)).select(
        "source_table", F.col("column_name").alias("flag_column")
    )
    per_table = flags.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_flags"))
    members = catalog.filter(~F.col("column_name").endswith(suffix)).select(
        "source_table", F.col("column_name").alias("member_column")
    )
    prefix = F.expr(f"left(flag_column, length(flag_column) - {len(suffix)})")
    return (
        flags.join(per_table, "source_table")
        .join(members, "source_table", "left")
        .withColumn(
            "member_column",
            F.when((F.col("n_flags") == 1) | F.startswith(F.col("member_column"), prefix), F.col("member_column")),
        )
        .select("flag_column", "member_column")
        .distinct()
    )


def flag_consistency(df: DataFrame, groups: Mapping[str, Sequence[str]], region: Column) -> DataFrame:
    """Does each flag explain its members' nulls?  Counts per (scope, flag), one scan.

    A NULL flag counts as neither true nor false; a flag without members gives zeros.
    """
    rows = []
    for flag, members in groups.items():
        on, off = F.col(flag) == F.lit(True), F.col(flag) == F.lit(False)
        empty = all_null(*members) if members else F.lit(False)
        some = F.lit(bool(members))
        rows.append(
            F.struct(
                F.lit(flag).alias("flag_column"),
                F.lit(len(members)).alias("n_member_columns"),
                count_where(on & some).alias("n_covered_true"),
                count_where(off & some).alias("n_covered_false"),
                count_where(on & some & empty).alias("n_true_but_all_null"),
                count_where(off & some & ~empty).alias("n_false_but_some_value"),
            )
        )
    per_region = df.groupBy(region.alias("region")).agg(F.array(*rows).alias("rows")).select("region", F.inline("rows"))
    scopes = F.explode(F.array_compact(F.array(F.lit(NATIONAL), F.col("region"))))
    counts = ["n_covered_true", "n_covered_false", "n_true_but_all_null", "n_false_but_some_value"]
    return (
        per_region.withColumn("scope", scopes)
        .groupBy("scope", "flag_column", "n_member_columns")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )


def domain_pivot(profile: DataFrame, scopes: Sequence[str], excluded: Sequence[str] = ("geography", "population")) -> DataFrame:
    """Mean null share per domain, one column per scope."""
    kept = profile.filter(~F.col("domain").isin(list(excluded)))
    return kept.groupBy("domain").pivot("scope", list(scopes)).agg(F.avg("pct_null"))


def value_share(df: DataFrame, value: str, by: str, wanted: Sequence[str]) -> DataFrame:
    """Value counts (NULL included) with each value's share of its group in percent.

    Counts are taken first; the group totals are then sums over the counts, not the rows.
    """
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).select(
        by,
        value,
        "n",
        (100.0 * F.col("n") / F.col("total")).alias("pct_of_group"),
        F.coalesce(F.col(value).isin(list(wanted)), F.lit(False)).alias("in_filter"),
    )


def filter_retention(shares: DataFrame, by: str) -> DataFrame:
    """Share of each group kept by the filter, in percent."""
    return shares.filter("in_filter").groupBy(by).agg(F.sum("pct_of_group").alias("pct_kept"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 15) -> DataFrame:
    """Most frequent values per column as text, with how many more there are.

    Ties are ordered by value.  Only ``k`` values per column are gathered.
    """
    counted = (
        _cells(df, columns, F.lit(None).cast("string"))
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n_distinct = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    best = top_per_group(counted, ["column_name"], [F.desc("n"), F.asc("value")], k)
    shown = best.groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("items")
    )
    texts = F.transform("items", lambda i: F.concat(i["value"], F.lit(" ("), i["n"].cast("string"), F.lit(")")))
    more = F.when(
        F.col("n_distinct") > k,
        F.format_string("; ... +%d more distinct value(s)", F.col("n_distinct") - k),
    ).otherwise("")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    listed = every.join(shown, "column_name", "left").join(n_distinct, "column_name", "left")
    return listed.select(
        "column_name",
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.when(F.col("items").isNull(), F.lit("(all null)"))
        .otherwise(F.concat(F.array_join(texts, "; "), more))
        .alias("values"),
    )


def duplicate_keys(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of a key beyond its first; all NULL keys form one group."""
    counted = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("duplicate_count"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Weighted mean and rows used, leaving out missing values and weights <= 0."""
    v, w = number(value), number(weight)
    used = v.isNotNull() & (w > 0)
    total = F.sum(F.when(used, w))
    return df.groupBy(*by).agg(
        (F.sum(F.when(used, v * w)) / total).alias("weighted_mean"),
        count_where(used).alias("n_used"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.corr(a, b).alias("corr"))
                for a, b in pairs
            ]
        ).alias("rows")
    )
    return rows.select(F.inline("rows"))


def source_mix(df: DataFrame, sources: str, by: Sequence[str]) -> DataFrame:
    """Nested source lists: elements per dataset, how many report confidence, their mean.

    ``max_elements`` and ``empty_lists`` describe the lists themselves.
    """
    items = df.select(*by, F.explode(sources).alias("s")).filter(F.col("s").isNotNull())
    mixed = items.groupBy(*by, F.col("s.dataset").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(number("s.confidence")).alias("n_confident"),
        F.avg(number("s.confidence")).alias("mean_confidence"),
    )
    size = F.coalesce(F.size(sources), F.lit(0))
    size = F.greatest(size, F.lit(0))
    lists = df.groupBy(*by).agg(F.max(size).alias("max_elements"), count_where(size == 0).alias("empty_lists"))
    share = 100.0 * F.col("n_confident") / F.col("n")
    return mixed.join(lists, list(by)).select(
        *by, "dataset", "n", share.alias("confident_pct"), "mean_confidence", "max_elements", "empty_lists"
    )


def near_misses(distinct_values: DataFrame, value: str, documented: Sequence[str]) -> DataFrame:
    """Real values that resemble a documented one without being it.

    Either contains the other after trimming and lower-casing, or both are then equal.  The
    documented list is a constant, so each distinct value is compared in place.
    """
    real = F.lower(F.trim(F.col(value)))
    hits = [
        F.when(
            (F.col(value) != d) & (F.contains(real, F.lit(d.strip().lower())) | F.contains(F.lit(d.strip().lower()), real)),
            F.lit(d),
        )
        for d in documented
    ]
    found = F.explode(F.array_compact(F.array(*hits)))
    return distinct_values.filter(F.col(value).isNotNull()).select(found.alias("documented"), F.col(value).alias("near_miss"))
