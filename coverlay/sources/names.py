"""Column names and categories that tables and outputs must carry unchanged."""

from __future__ import annotations

# Raw counts and lengths per zone.
RAW_COLUMNS = (
    "overture_transport_length_m",
    "tiger_transport_length_m",
    "overture_building_count_centroid",
    "overture_building_count_intersection",
    "microsoft_building_count_centroid",
    "microsoft_building_count_intersection",
    "overture_poi_count_fire",
    "hifld_count_fire",
    "overture_poi_count_ems",
    "hifld_count_ems",
    "overture_poi_count_schools",
    "hifld_count_schools",
    "overture_places_count",
)
ESTABLISHMENT_COLUMN = "cbp_estab_bus"

# Each gap with its flag, and the observed / reference pair it compares.
GAPS = {
    "transport_gap": ("transport_defined", "overture_transport_length_m", "tiger_transport_length_m"),
    "building_gap_centroid": (
        "building_gap_centroid_defined",
        "overture_building_count_centroid",
        "microsoft_building_count_centroid",
    ),
    "building_gap_intersection": (
        "building_gap_intersection_defined",
        "overture_building_count_intersection",
        "microsoft_building_count_intersection",
    ),
    "poi_gap_fire": ("poi_gap_fire_defined", "overture_poi_count_fire", "hifld_count_fire"),
    "poi_gap_ems": ("poi_gap_ems_defined", "overture_poi_count_ems", "hifld_count_ems"),
    "poi_gap_schools": ("poi_gap_schools_defined", "overture_poi_count_schools", "hifld_count_schools"),
    "poi_gap_establishments": ("poi_gap_establishments_defined", "overture_places_count", "cbp_estab_bus"),
}
GAP_COLUMNS = tuple(GAPS)
GAP_FLAGS = tuple(flag for flag, _, _ in GAPS.values())
FACILITY_GAPS = ("poi_gap_fire", "poi_gap_ems", "poi_gap_schools")
DISPATCH_COLUMNS = (
    "dispatch_blind_threshold_and",
    "dispatch_blind_normalized_euclidean",
    "dispatch_blind_product",
    "dispatch_blind_dari",
)

# Road classes and place categories that count, by exact match only.
NAMED_ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary")
NAMED_ROAD_CODES = ("S1100", "S1200")
PLACE_CATEGORIES = {
    "fire": ("fire_department",),
    "ems": ("ambulance_and_ems_services",),
    "schools": (
        "elementary_school",
        "middle_school",
        "high_school",
        "school",
        "private_school",
        "public_school",
    ),
}

# The output table.
OUTPUT_RENAMES = {
    "poi_gap_establishments": "poi_gap_cbp",
    "poi_gap_fire_defined": "poi_defined_fire",
    "poi_gap_ems_defined": "poi_defined_ems",
    "poi_gap_schools_defined": "poi_defined_schools",
    "poi_gap_establishments_defined": "poi_defined_cbp",
}
OUTPUT_COLUMNS = (
    "GEOID",
    "coverage_gap_score",
    "region",
    "transport_gap",
    "transport_defined",
    "building_gap",
    "building_defined",
    "poi_gap",
    "poi_defined",
    "poi_gap_fire",
    "poi_defined_fire",
    "poi_gap_ems",
    "poi_defined_ems",
    "poi_gap_schools",
    "poi_defined_schools",
    "poi_gap_cbp",
    "poi_defined_cbp",
)
OUTPUT_FLAGS = tuple(c for c in OUTPUT_COLUMNS if "defined" in c)
OUTPUT_VALUES = tuple(c for c in OUTPUT_COLUMNS if c not in OUTPUT_FLAGS and c not in ("GEOID", "region"))

# The curated strata columns and their roles.
COMPETITION, RESEARCH, DIAGNOSTIC = "competition", "research", "diagnostic"
STRATA_ROLES = {
    "svi_overall": RESEARCH,
    "svi_socioeconomic": RESEARCH,
    "svi_household": RESEARCH,
    "svi_minority": RESEARCH,
    "svi_housing_transport": RESEARCH,
    "svi_covered": DIAGNOSTIC,
    "tribal_any": RESEARCH,
    "tribal_legal": RESEARCH,
    "tribal_statistical": RESEARCH,
    "tribal_pct": RESEARCH,
    "tribal_legal_pct": RESEARCH,
    "tribal_stat_pct": RESEARCH,
    "aiannh_kind": RESEARCH,
    "aiannh_name": RESEARCH,
    "ruca_primary": RESEARCH,
    "ruca_primary_desc": RESEARCH,
    "ruca_pop_density": RESEARCH,
    "ruca_covered": DIAGNOSTIC,
    "rucc_2023": RESEARCH,
    "rucc_desc": RESEARCH,
    "rucc_metro": RESEARCH,
    "rucc_covered": DIAGNOSTIC,
    "nchs_2013": RESEARCH,
    "nchs_2013_label": RESEARCH,
    "nchs_covered": DIAGNOSTIC,
    "epht_heat_days_annual": RESEARCH,
    "epht_heat_days_summer": RESEARCH,
    "epht_covered": DIAGNOSTIC,
    "gehe_wbgt30_days_mean": RESEARCH,
    "uhe_himax461_days_per_yr": RESEARCH,
    "uhe_covered": DIAGNOSTIC,
    "hwd_heatindex_mean": RESEARCH,
    "usfs_WHP_mean": RESEARCH,
    "usfs_covered": DIAGNOSTIC,
    "mtbs_wildfire_burned_pct_land": RESEARCH,
    "mtbs_wildfire_ever": RESEARCH,
    "mtbs_covered": DIAGNOSTIC,
    "nifc_wildfire_ever": RESEARCH,
    "fod_ignition_density": RESEARCH,
    "carbonplan_bp_2011_mean": RESEARCH,
    "pmdi_mean": RESEARCH,
    "pmdi_covered": DIAGNOSTIC,
    "spi12_mean": RESEARCH,
    "spi_covered": DIAGNOSTIC,
    "usdm_summer_pct_d2plus": RESEARCH,
    "usdm_winter_pct_d2plus": RESEARCH,
    "usdm_covered": DIAGNOSTIC,
    "cvi_overall": RESEARCH,
    "cvi_baseline": RESEARCH,
    "cvi_baseline_socioeconomic": RESEARCH,
    "cvi_baseline_health": RESEARCH,
    "cvi_baseline_environment": RESEARCH,
    "cvi_baseline_infrastructure": RESEARCH,
    "cvi_climate": RESEARCH,
    "cvi_climate_extreme_events": RESEARCH,
    "cvi_climate_health": RESEARCH,
    "cvi_climate_socioeconomic": RESEARCH,
    "cvi_covered": DIAGNOSTIC,
    "pop_total": RESEARCH,
    "pop_urban": RESEARCH,
    "pop_rural": RESEARCH,
    "pct_urban": RESEARCH,
    "ur_class": RESEARCH,
}
STRATA_COLUMNS = tuple(STRATA_ROLES)
COLUMN_ROLES = {c: COMPETITION for c in (*GAP_COLUMNS, *GAP_FLAGS)} | STRATA_ROLES
