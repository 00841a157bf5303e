"""Per-zone features derived from records and strata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.functions.values import number
from coverlay.operators.contracts import require_columns
from coverlay.operators.ordering import median_split, top_per_group


def confidence_features(records: DataFrame, zone: str, confidence: str) -> DataFrame:
    """Share of records reporting a confidence, and the mean of those that do.

    Kept apart on purpose: a missing value lowers the rate, never the mean.
    """
    value = number(confidence)
    return records.groupBy(zone).agg(
        (F.count(value) / F.count(F.lit(1))).alias("confidence_reporting_rate"),
        F.avg(value).alias("mean_reported_confidence"),
    )


# Dataset names as they appear in source lists.
OSM_DATASET, MICROSOFT_WORD, GOOGLE_WORD = "OpenStreetMap", "Microsoft", "Google"


def source_provenance(records: DataFrame, zone: str, dataset: str) -> DataFrame:
    """Share of each source family, number of elements, dominant source and entropy.

    Counts per (zone, dataset) come first, so a zone with very many records is reduced
    map-side.  Ties for dominance go to the first name in alphabetical order.
    """
    counts = records.filter(F.col(dataset).isNotNull()).groupBy(zone, dataset).agg(F.count(F.lit(1)).alias("n"))
    n, name = F.col("n"), F.col(dataset)
    total = F.sum(n)

    def part(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)) / total

    osm, microsoft = part(name == OSM_DATASET), part(name.contains(MICROSOFT_WORD))
    google = part(name.contains(GOOGLE_WORD))
    return counts.groupBy(zone).agg(
        osm.alias("osm_share"),
        microsoft.alias("microsoft_share"),
        google.alias("google_share"),
        F.greatest(F.lit(0.0), 1 - osm - microsoft - google).alias("other_share"),
        total.alias("n_sources"),
        F.min_by(name, F.struct(-n, name)).alias("dominant_source"),
        # -sum(p ln p) with p = n / total, without a second pass for the total
        (F.log(total) - F.sum(n * F.log(n)) / total).alias("source_entropy"),
    )


def onto_zones(zones: DataFrame, tables: Sequence[DataFrame], zone: str, zero: Sequence[str] = ()) -> DataFrame:
    """Left-join per-zone tables onto the full zone list; listed columns become 0 when absent."""
    out = zones
    for table in tables:
        out = out.join(table, zone, "left")
    return out.fillna(0, subset=list(zero)) if zero else out


def join_strata(zones: DataFrame, strata: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Attach the curated strata columns; a missing one is an error naming it."""
    require_columns(strata, [key, *columns], "strata")
    return zones.join(strata.select(key, *columns), key, "left")


def strata_flags(
    strata: DataFrame,
    key: str = "GEOID",
    region: str = "region",
    tribal_id: str = "aiannh_geoid",
    pct_urban: str = "pct_urban",
    vulnerability: str = "svi_overall",
    covered: str = "svi_covered",
) -> DataFrame:
    """Tribal, rural and high-vulnerability flags; the last is NULL where not covered."""
    require_columns(strata, [tribal_id, pct_urban, vulnerability, covered], "strata")
    flagged = strata.withColumns(
        {
            "is_tribal": F.col(tribal_id).isNotNull(),
            "is_rural": F.coalesce(number(pct_urban) < 50, F.lit(False)),
        }
    )
    split = median_split(flagged, vulnerability, covered, region, "is_high_vulnerability")
    return split.select(key, region, "is_tribal", "is_rural", "is_high_vulnerability")


def stratified_pick(
    candidates: DataFrame, quotas: Mapping[str, int], key: str = "GEOID", region: str = "region", score: str = "score"
) -> DataFrame:
    """Zones to check by hand: per region one water-dominated, one tribal, one rural and one
    urban zone, then the highest scores until the quota is met.

    Each later step skips zones already taken, and at most four can be.  So the first few of
    every category decide the pick, and only those are shuffled.
    """
    depth = max(quotas.values()) + 5
    categories = {
        "water": F.col("is_water"),
        "tribal": F.col("is_tribal"),
        "rural": F.col("is_rural"),
        "urban": ~F.col("is_rural"),
    }
    tagged = candidates.filter(F.col(region).isin(list(quotas))).select(
        region,
        key,
        F.explode(F.array_compact(F.array(F.lit("score"), *[F.when(c, F.lit(n)) for n, c in categories.items()]))).alias("category"),
        number(score).alias("score"),
    )
    order = F.when(F.col("category") == "score", -F.col("score"))
    best = top_per_group(tagged, [region, "category"], [order.asc_nulls_last(), F.col(key)], depth)
    ordered = F.array_sort(F.collect_list(F.struct("rank", key)))
    lists = best.groupBy(region).pivot("category", [*categories, "score"]).agg(ordered)
    for name in [*categories, "score"]:
        keys = F.transform(F.coalesce(name, F.array()), lambda s: s[key])
        lists = lists.withColumn(name, F.coalesce(keys, F.array().cast("array<string>")))
    quota = F.try_element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col(region))
    picks = F.slice("water", 1, 1)
    lists = lists.withColumn("picks", picks)
    for name in ("tribal", "rural", "urban"):
        fresh = F.slice(F.array_except(name, "picks"), 1, 1)
        room = F.lit(True) if name == "tribal" else F.size("picks") < quota
        lists = lists.withColumn("picks", F.when(room, F.concat("picks", fresh)).otherwise(F.col("picks")))
    full = F.slice(F.concat("picks", F.array_except("score", "picks")), F.lit(1), quota)
    return lists.select(region, F.posexplode(full).alias("position", key)).withColumn("position", F.col("position") + 1)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_group(df, key, order, 1, "_first").drop("_first")


def attach_region(df: DataFrame, region: str) -> DataFrame:
    return df.withColumn("region", F.lit(region))
