"""Raw counts and lengths per zone for every observed / reference pair, and their gaps.

Both sides of a pair are stacked with a ``side`` label and go through one spatial join, so
each component costs one pass over its layers and one small per-zone shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.functions.gaps import capped_ratio_gap, gap_defined
from coverlay.operators.features import onto_zones
from coverlay.operators.sets import union_scopes
from coverlay.operators.spatial_join import (
    ZoneIndex,
    clipped_length,
    count_pairs,
    count_points_where,
    polygon_pairs,
)
from coverlay.sources.names import ESTABLISHMENT_COLUMN, GAPS, PLACE_CATEGORIES, RAW_COLUMNS

OBSERVED, REFERENCE = "observed", "reference"


def _both_sides(observed: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    return union_scopes(
        [
            observed.select(*columns, F.lit(OBSERVED).alias("side")),
            reference.select(*columns, F.lit(REFERENCE).alias("side")),
        ]
    )


def _per_side(counts: DataFrame, value: str, names: Mapping[str, str]) -> DataFrame:
    """(zone, side) rows to one column per side."""
    return counts.groupBy("zone_id").agg(
        *[F.sum(F.when(F.col("side") == side, F.col(value))).alias(name) for side, name in names.items()]
    )


def transport_lengths(
    observed: DataFrame, reference: DataFrame, zones: ZoneIndex, fid: Sequence[str], measure: str = "equal_area"
) -> DataFrame:
    """Clipped road length per zone and side.  Filter both layers to named roads first."""
    lines = _both_sides(observed, reference, [*fid, "geom"])
    lengths = clipped_length(lines, zones, [*fid], by=["side"], measure=measure)
    return _per_side(
        lengths, "length", {OBSERVED: "overture_transport_length_m", REFERENCE: "tiger_transport_length_m"}
    )


def building_counts(
    observed: DataFrame,
    reference: DataFrame,
    zones: ZoneIndex,
    fid: Sequence[str],
    centroid_space: str = "equal_area",
) -> DataFrame:
    """Buildings per zone and side under the centroid and the intersection rule, in one pass."""
    kept = [*fid, "geom"]
    kept += [c for c in ("xmin", "ymin", "xmax", "ymax") if c in observed.columns and c in reference.columns]
    layers = _both_sides(observed, reference, kept)
    pairs = polygon_pairs(layers, zones, fid, centre=centroid_space, keep=[*fid, "side"])
    counts = count_pairs(pairs, fid, ["zone_id", "side"], "intersection", {"centroid": "centred"})
    return counts.groupBy("zone_id").agg(
        *[
            F.sum(F.when(F.col("side") == side, F.col(rule))).alias(f"{source}_building_count_{rule}")
            for rule in ("centroid", "intersection")
            for side, source in ((OBSERVED, "overture"), (REFERENCE, "microsoft"))
        ]
    )


def place_counts(
    places: DataFrame,
    facilities: Mapping[str, DataFrame],
    zones: ZoneIndex,
    category: Column,
    categories: Mapping[str, Sequence[str]] = PLACE_CATEGORIES,
) -> DataFrame:
    """Places per zone, by facility sub-type and in total, next to the facility layers.

    All point layers are stacked and joined once; each count is a condition on the result.
    Categories match exactly: "security_systems" contains "ems" and must not count.
    """
    stacked = union_scopes(
        [places.select("x", "y", F.lit("places").alias("layer"), category.alias("category"))]
        + [
            layer.select("x", "y", F.lit(name).alias("layer"), F.lit(None).cast("string").alias("category"))
            for name, layer in facilities.items()
        ]
    )
    observed = F.col("layer") == "places"
    counts: dict[str, Column] = {}
    for name in facilities:
        counts[f"overture_poi_count_{name}"] = observed & F.col("category").isin(list(categories[name]))
        counts[f"hifld_count_{name}"] = F.col("layer") == name
    counts["overture_places_count"] = observed
    return count_points_where(stacked, zones, counts)


def candidate_gaps(raw: DataFrame) -> DataFrame:
    """Every capped-ratio gap with its flag, next to the raw columns."""
    columns: dict[str, Column] = {}
    for gap, (flag, observed, reference) in GAPS.items():
        columns[gap] = capped_ratio_gap(observed, reference)
        columns[flag] = gap_defined(reference)
    return raw.withColumns(columns)


def zone_ingredients(
    zones: DataFrame, transport: DataFrame, buildings: DataFrame, places: DataFrame, establishments: DataFrame
) -> DataFrame:
    """Full zone list with raw columns and gaps.

    A zone absent from a join had no match, which is a true 0.  Establishment counts are the
    exception: they can be withheld, and then stay NULL.
    """
    raw = onto_zones(
        zones,
        [transport, buildings, places, establishments.select("zone_id", ESTABLISHMENT_COLUMN)],
        "zone_id",
        zero=RAW_COLUMNS,
    )
    return candidate_gaps(raw)
