"""Gap arithmetic as Column expressions.

Everything here stays inside whole-stage codegen.  "Undefined" is always NULL plus a
false flag, never zero: a zone with nothing to compare against must not look covered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlay.functions.values import as_column, number


def capped_ratio_gap(observed: Column | str, reference: Column | str) -> Column:
    """``1 - min(1, observed / reference)``; NULL unless the reference is positive."""
    seen, expected = number(observed), number(reference)
    usable = (expected > 0) & seen.isNotNull()
    return F.when(usable, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), seen / expected)))


def gap_defined(reference: Column | str) -> Column:
    """True only where the reference is present and positive; never NULL."""
    return F.coalesce(number(reference) > 0, F.lit(False))


def mean_of_defined(*columns: Column | str) -> Column:
    """Horizontal mean over the non-null inputs; NULL when none is defined."""
    values = [number(c) for c in columns]
    total = reduce(Column.__add__, [F.coalesce(v, F.lit(0.0)) for v in values])
    count = reduce(Column.__add__, [v.isNotNull().cast("int") for v in values])
    return F.when(count > 0, total / count)


def coverage_gap_score(*components: Column | str) -> Column:
    """Composite score: the mean of whichever component gaps are defined."""
    return mean_of_defined(*components)


def flagged_mean(values: Sequence[Column | str], flags: Sequence[Column | str]) -> Column:
    """Mean over the values whose flag is set.

    The flag decides membership, not the value: placeholders of 0 sit under false flags.
    A set flag over a NULL value makes the mean NULL.
    """
    on = [F.coalesce(as_column(f), F.lit(False)) for f in flags]
    total = reduce(
        Column.__add__, [F.when(f, number(v)).otherwise(F.lit(0.0)) for v, f in zip(values, on)]
    )
    count = reduce(Column.__add__, [f.cast("int") for f in on])
    return F.when(count > 0, total / count)


def nested_poi_gap(
    facility: Mapping[str, str], establishments: tuple[str, str]
) -> tuple[Column, Column]:
    """Two-level mean: facility sub-types first, then that half with the establishment half.

    ``facility`` maps each sub-type gap column to its flag column.
    """
    facility_half = flagged_mean(list(facility), list(facility.values()))
    value, flag = establishments
    other_half = F.when(F.coalesce(F.col(flag), F.lit(False)), number(value))
    gap = mean_of_defined(facility_half, other_half)
    return gap, gap.isNotNull()


def by_region(default: str, overrides: Mapping[str, str], region: str = "region") -> Column:
    """Pick a column per region: the override where one is given, else the default."""
    chosen = F.col(default)
    for name, column in sorted(overrides.items()):
        chosen = F.when(F.col(region) == name, F.col(column)).otherwise(chosen)
    return chosen


def dispatch_blind(transport_gap: Column | str, facility_gap: Column | str) -> dict[str, Column]:
    """Four ways to combine "hard to reach by road" with "no station mapped"."""
    road, station = number(transport_gap), number(facility_gap)
    both_bad = F.coalesce((road > 0.5) & (station > 0.5), F.lit(False))
    return {
        "dispatch_blind_threshold_and": both_bad.cast("double"),
        "dispatch_blind_normalized_euclidean": F.sqrt(road * road + station * station)
        / F.sqrt(F.lit(2.0)),
        "dispatch_blind_product": road * station,
        "dispatch_blind_dari": 1 - (1 - road) * (1 - station),
    }


def component_dominance(gaps: Sequence[str], flags: Mapping[str, str]) -> dict[str, Column]:
    """Largest gap (first listed wins ties), number of defined gaps, names of undefined ones."""
    largest = F.greatest(*[number(g) for g in gaps]) if len(gaps) > 1 else number(gaps[0])
    dominant = F.coalesce(*[F.when(number(g) == largest, F.lit(g)) for g in gaps])
    on = {g: F.coalesce(F.col(flags[g]), F.lit(False)) for g in gaps}
    return {
        "dominant_component": dominant,
        "n_components_defined": reduce(Column.__add__, [c.cast("int") for c in on.values()]),
        "undefined_components": F.concat_ws(",", *[F.when(~c, F.lit(g)) for g, c in on.items()]),
    }


def any_null(*columns: Column | str) -> Column:
    return reduce(Column.__or__, [as_column(c).isNull() for c in columns])


def all_null(*columns: Column | str) -> Column:
    return reduce(Column.__and__, [as_column(c).isNull() for c in columns])


def water_fraction(land: Column | str, water: Column | str) -> Column:
    """Water share of the zone's total area; NULL when the total is zero."""
    land, water = number(land), number(water)
    return F.when(land + water != 0, water / (land + water))


def water_area_proxy(total_area: Column | str, land: Column | str) -> Column:
    """Area left over after land, for tables without a water column; noise below 0 is cut."""
    rest = number(total_area) - number(land)
    return F.when(rest.isNotNull(), F.greatest(rest, F.lit(0.0)))


def clip(value: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    value = number(value)
    bounded = value
    if upper is not None:
        bounded = F.least(bounded, F.lit(float(upper)))
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(float(lower)))
    return F.when(value.isNotNull(), bounded)
