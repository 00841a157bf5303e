"""From zone features to the composite score, its variants and the validated output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.functions.gaps import by_region, coverage_gap_score, nested_poi_gap
from coverlay.functions.values import count_where
from coverlay.operators.contracts import ContractViolation, require_columns, select_allowed, with_roles
from coverlay.operators.sets import missing_keys, presence, union_scopes
from coverlay.sources.names import (
    COLUMN_ROLES,
    COMPETITION,
    FACILITY_GAPS,
    OUTPUT_COLUMNS,
    OUTPUT_FLAGS,
    OUTPUT_RENAMES,
    OUTPUT_VALUES,
)

BUILDING_RULES = ("building_gap_centroid", "building_gap_intersection")
DEFAULT_BUILDING_RULE = "building_gap_centroid"
POI_GAPS = (*FACILITY_GAPS, "poi_gap_establishments")


def score_zones(features: DataFrame, overrides: Mapping[str, str] | None = None, key: str = "GEOID") -> DataFrame:
    """Score all regions in one pass.

    ``overrides`` names another building rule for single regions.  Only columns whose role
    is ``competition`` can be read, so no strata column can leak into a score.
    """
    overrides = dict(overrides or {})
    used = [
        "transport_gap",
        "transport_defined",
        *sorted({DEFAULT_BUILDING_RULE, *overrides.values()}),
        *sorted({f"{c}_defined" for c in (DEFAULT_BUILDING_RULE, *overrides.values())}),
        *POI_GAPS,
        *[f"{c}_defined" for c in POI_GAPS],
    ]
    allowed = select_allowed(with_roles(features, COLUMN_ROLES), used, COMPETITION, keys=[key, "region"])
    flags = {f"{r}": f"{c}_defined" for r, c in overrides.items()}
    poi_gap, poi_defined = nested_poi_gap(
        {c: f"{c}_defined" for c in FACILITY_GAPS}, ("poi_gap_establishments", "poi_gap_establishments_defined")
    )
    parts = allowed.select(
        key,
        "region",
        "transport_gap",
        "transport_defined",
        by_region(DEFAULT_BUILDING_RULE, overrides).alias("building_gap"),
        by_region(f"{DEFAULT_BUILDING_RULE}_defined", flags).alias("building_defined"),
        poi_gap.alias("poi_gap"),
        poi_defined.alias("poi_defined"),
        *[c for gap in POI_GAPS for c in (gap, f"{gap}_defined")],
    )
    return parts.withColumn("coverage_gap_score", coverage_gap_score("transport_gap", "building_gap", "poi_gap"))


def compare_rules(features: DataFrame, variants: Mapping[str, Mapping[str, str]], baseline: str, key: str = "GEOID") -> DataFrame:
    """Score every variant of the building rule; per zone, its difference to the baseline."""
    scored = union_scopes(
        [score_zones(features, v, key).select(key, "region", "coverage_gap_score", F.lit(n).alias("variant")) for n, v in variants.items()]
    )
    base = scored.filter(F.col("variant") == baseline).select(key, F.col("coverage_gap_score").alias("_base"))
    return scored.join(base, key).select(
        "variant", key, "region", "coverage_gap_score", (F.col("coverage_gap_score") - F.col("_base")).alias("delta")
    )


def region_deltas(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("variant", "region").agg(
        F.avg("coverage_gap_score").alias("mean_score"),
        F.avg(F.abs("delta")).alias("mean_abs_delta"),
        F.max(F.abs("delta")).alias("max_abs_delta"),
    )


def build_output(scored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Exactly the manifest's zones, in the output layout; undefined gaps become 0 with a false flag."""
    lost = missing_keys(manifest, scored, ["GEOID"]).select("GEOID").limit(5).collect()
    if lost:
        raise ContractViolation(f"manifest zones without a score, first few: {[r[0] for r in lost]}")
    return fill_output(scored, manifest)


def fill_output(scored: DataFrame, manifest: DataFrame) -> DataFrame:
    renamed = scored.drop("region").withColumnsRenamed(OUTPUT_RENAMES)
    joined = manifest.select("GEOID", "region").join(renamed, "GEOID", "left")
    return joined.fillna(0.0, subset=list(OUTPUT_VALUES)).fillna(False, subset=list(OUTPUT_FLAGS)).select(*OUTPUT_COLUMNS)


def placeholder_output(manifest: DataFrame) -> DataFrame:
    """Every manifest zone at the midpoint and defined, to try the layout alone."""
    values = {c: F.lit(0.5) for c in OUTPUT_VALUES} | {c: F.lit(True) for c in OUTPUT_FLAGS}
    return manifest.select("GEOID", "region").withColumns(values).select(*OUTPUT_COLUMNS)


def output_report(output: DataFrame, manifest: DataFrame) -> DataFrame:
    """``position, check_name, violations`` for every output check, in reporting order."""
    columns = list(OUTPUT_COLUMNS)
    blank = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
    outside = reduce(Column.__or__, [~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)) for c in OUTPUT_VALUES])
    sides = union_scopes(
        [output.select("region", F.lit(1).alias("d")), manifest.select("region", F.lit(-1).alias("d"))]
    )
    per_region = sides.groupBy("region").agg(F.sum("d").alias("d"))
    keys = presence(output, manifest, ["GEOID"])

    def row(position: int, name: str, value: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("check_name"), value.cast("bigint").alias("violations")
        )

    zero = F.lit(0)
    parts = [
        per_region.agg(
            F.array(
                row(1, "row count", F.abs(F.coalesce(F.sum("d"), zero))),
                row(2, "rows per region", count_where(F.col("d") != 0)),
            ).alias("rows")
        ),
        keys.agg(
            F.array(
                row(3, "unknown keys", count_where(F.col("in_left") & ~F.col("in_right"))),
                row(4, "missing keys", count_where(~F.col("in_left") & F.col("in_right"))),
            ).alias("rows")
        ),
        output.agg(F.array(row(5, "blank cells", count_where(blank)), row(6, "outside [0, 1]", count_where(outside))).alias("rows")),
    ]
    return union_scopes([p.select(F.inline("rows")) for p in parts])


def validate_output(output: DataFrame, manifest: DataFrame) -> DataFrame:
    """Return the output, or raise on the first check that fails."""
    require_columns(output, OUTPUT_COLUMNS, "output")
    for bad in output_report(output, manifest).orderBy("position").collect():
        if bad["violations"]:
            raise ContractViolation(f"output: {bad['check_name']}: {bad['violations']} violation(s)")
    return output


def any_undefined_share(scored: DataFrame, flags: Sequence[str] = ("transport_defined", "building_defined", "poi_defined")) -> DataFrame:
    """Percent of zones per region with at least one undefined component."""
    undefined = ~reduce(Column.__and__, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return scored.groupBy("region").agg((100.0 * F.avg(undefined.cast("double"))).alias("pct_any_undefined"))


def ratio_band(totals: DataFrame, observed: str, reference: str, low: float = 0.71, high: float = 1.59) -> DataFrame:
    """Observed / reference totals per region and whether the ratio lies in the usual band."""
    sums = totals.groupBy("region").agg(F.sum(observed).alias("observed"), F.sum(reference).alias("reference"))
    ratio = F.when(F.col("reference") > 0, F.col("observed") / F.col("reference"))
    back = F.when(F.col("observed") > 0, F.col("reference") / F.col("observed"))
    return sums.select(
        "region", "observed", "reference", ratio.alias("ratio"), back.alias("inverse_ratio"),
        F.coalesce(ratio.between(low, high), F.lit(False)).alias("in_band"),
    )


def over_count(observed: DataFrame, reference: DataFrame, by: str, limit: float = 3.0) -> DataFrame:
    """How many times more records one layer holds than another, per group."""
    seen = observed.groupBy(by).agg(F.count(F.lit(1)).alias("observed"))
    known = reference.groupBy(by).agg(F.count(F.lit(1)).alias("reference"))
    ratio = F.when(F.col("reference") > 0, F.col("observed") / F.col("reference"))
    return (
        seen.join(known, by, "full")
        .fillna(0, subset=["observed", "reference"])
        .select(by, "observed", "reference", ratio.alias("ratio"), F.coalesce(ratio > limit, F.lit(False)).alias("over_counted"))
    )


def flag_mismatches(stored: DataFrame, recomputed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose stored value differs from the recomputed one (both missing is equal)."""
    joined = stored.alias("a").join(recomputed.alias("b"), key)
    rows = joined.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), count_where(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias("mismatches"))
                for c in columns
            ]
        ).alias("rows")
    )
    return rows.select(F.inline("rows"))
