"""Contracts of the known layers and of the zone feature table."""

from __future__ import annotations

from coverlay.operators.contracts import Contract, Rule, digits, non_negative, present, share, text
from coverlay.sources.names import (
    DISPATCH_COLUMNS,
    GAP_COLUMNS,
    GAP_FLAGS,
    RAW_COLUMNS,
    STRATA_COLUMNS,
)

OBSERVED_BUILDINGS = Contract(
    "observed-buildings",
    (text("subtype"), text("class"), present("sources"), present("geometry")),
)
OBSERVED_ROADS = Contract(
    "observed-roads",
    (text("subtype", nullable=False), text("class"), present("geometry")),
)
OBSERVED_PLACES = Contract(
    "observed-places",
    (present("categories"), share("confidence"), present("geometry")),
)
REFERENCE_BUILDINGS = Contract(
    "reference-buildings",
    (
        Rule("height", ("double",)),
        share("confidence", placeholder=-1.0),
        present("bbox", required=False),
        present("geometry"),
    ),
    strict=True,
)
REFERENCE_ROADS = Contract(
    "reference-roads",
    (
        text("LINEARID", nullable=False),
        text("FULLNAME"),
        text("RTTYP"),
        text("MTFCC", nullable=False, length=5),
        present("bbox", required=False),
        present("geometry"),
    ),
    strict=True,
)
FACILITIES = Contract(
    "reference-facilities",
    (
        present("permanent_identifier"),
        text("name"),
        present("ftype"),
        present("fcode"),
        present("admintype"),
        text("address"),
        text("city"),
        text("state"),
        present("zipcode"),
        present("gnis_id"),
        present("bbox", required=False),
        present("geometry"),
    ),
    strict=True,
)
ESTABLISHMENTS = Contract(
    "reference-establishments",
    (
        digits("GEOID", 11),
        digits("STATEFP", 2),
        digits("COUNTYFP", 3),
        digits("TRACTCE", 6),
        non_negative("cbp_estab"),
        non_negative("cbp_estab_res"),
        non_negative("cbp_estab_bus"),
        present("bbox", required=False),
        present("geometry"),
    ),
    strict=True,
)
ZONE_FEATURES = Contract(
    "zone-features",
    (
        digits("GEOID", 11),
        text("region", nullable=False),
        *[non_negative(c, nullable=False) for c in RAW_COLUMNS],
        non_negative("cbp_estab_bus"),
        *[share(c) for c in GAP_COLUMNS],
        *[Rule(c, ("boolean",), nullable=False) for c in GAP_FLAGS],
        *[share(c) for c in DISPATCH_COLUMNS],
        present("dominant_component"),
        non_negative("n_components_defined", nullable=False),
        text("undefined_components", nullable=False),
        *[present(c) for c in STRATA_COLUMNS],
    ),
)

LAYER_CONTRACTS: dict[str, Contract] = {
    "observed-buildings": OBSERVED_BUILDINGS,
    "observed-roads": OBSERVED_ROADS,
    "observed-places": OBSERVED_PLACES,
    "reference-buildings": REFERENCE_BUILDINGS,
    "reference-roads": REFERENCE_ROADS,
    "reference-fire-stations": FACILITIES,
    "reference-ems-stations": FACILITIES,
    "reference-schools": FACILITIES,
    "reference-hospitals": FACILITIES,
    "reference-establishments": ESTABLISHMENTS,
    "zone-features": ZONE_FEATURES,
}
