"""Assembly of the zone feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from coverlay.functions.gaps import component_dominance, dispatch_blind, mean_of_defined
from coverlay.operators.contracts import Contract, enforce, with_roles
from coverlay.operators.features import join_strata
from coverlay.sources.contracts import ZONE_FEATURES
from coverlay.sources.names import COLUMN_ROLES, GAPS, STRATA_COLUMNS


def derived_columns(ingredients: DataFrame) -> DataFrame:
    """Reachability combinations and the dominant / undefined components.

    Only fire and ambulance gaps enter reachability; schools do not dispatch.
    """
    station_gap = mean_of_defined("poi_gap_fire", "poi_gap_ems")
    return ingredients.withColumns(
        {
            **dispatch_blind("transport_gap", station_gap),
            **component_dominance(list(GAPS), {gap: flag for gap, (flag, _, _) in GAPS.items()}),
        }
    )


def zone_features(
    ingredients: DataFrame, strata: DataFrame, strata_columns: Sequence[str] = STRATA_COLUMNS, key: str = "GEOID"
) -> DataFrame:
    """Ingredients, strata and derived columns in one table, with column roles recorded."""
    return with_roles(derived_columns(join_strata(ingredients, strata, strata_columns, key)), COLUMN_ROLES)


def checked_zone_features(features: DataFrame, contract: Contract = ZONE_FEATURES) -> DataFrame:
    return enforce(features, contract)
