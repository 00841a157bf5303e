"""How strata columns are attributed, classified and tagged.

These lists describe the national strata tables by name and must be kept as they are for
the catalogue to come out right.  The operators in ``operators.catalog`` take them as data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coverlay.operators.catalog import RULES_TYPE

BACKBONE_TABLE = "national-census-tract-table"
BACKBONE_COLUMNS = (
    "GEOID",
    "STATEFP",
    "ALAND",
    "AWATER",
    "INTPTLAT",
    "INTPTLON",
    "COUNTYFP",
    "state_usps",
    "tract_vintage",
)
POPULATION_COLUMNS = ("pop_total", "pop_urban", "pop_rural", "pct_urban", "ur_class")

TABLE_DOMAINS = {
    "national-svi-tract-table": "svi",
    "national-cvi-tract-table": "cvi",
    "national-ruca-tract-table": "rurality",
    "national-rucc-tract-table": "rurality",
    "national-nchs-tract-table": "rurality",
    "national-tribal-tract-table": "tribal",
    "national-census-aiannh": "tribal",
    "national-census-tribal-subdivisions": "tribal",
    "national-census-tribal-tracts": "tribal",
    "national-usdm-drought-tract-table": "drought",
    "national-drought-gov-tract-table": "drought",
    "national-usfs-wildfire-tract-table": "wildfire",
    "national-usgs-combined-tract-table": "wildfire",
    "national-mtbs-tract-table": "wildfire",
    "national-nifc-tract-table": "wildfire",
    "national-fpa-fod-tract-table": "wildfire",
    "national-carbonplan-tract-table": "wildfire",
    "national-epht-heat-tract-table": "heat",
    "national-cdc-wonder-tract-table": "heat",
    "national-cdc-wonder-heat-mortality": "heat",
    "national-nasa-heat-tract-table": "heat",
    "national-noaa-ghcn-tract-table": "heat",
    "national-noaa-ghcn-stations": "heat",
    "national-census-tract-table": "geography",
    "national-census-tracts": "geography",
}
VALID_DOMAINS = ("svi", "cvi", "rurality", "tribal", "drought", "wildfire", "heat", "geography", "population")

# Role rules in priority order; the first that fits a column decides.
EXACT_ROLES = {
    "identifier": ("GEOID", "STATEFP", "COUNTYFP", "state_usps", "state_name"),
    "geometry_measure": ("ALAND", "AWATER", "INTPTLAT", "INTPTLON"),
    "population": POPULATION_COLUMNS,
    "identity_metadata": ("aiannh_geoid", "aiannh_name", "uhe_city_name", "uhe_city_country"),
    "vintage_metadata": (
        "carbonplan_version",
        "fod_edition", "fod_year_min", "fod_year_max",
        "mtbs_year_min", "mtbs_year_max", "mtbs_size_threshold",
        "nifc_year_min", "nifc_year_max",
        "usfs_edition", "usfs_extent",
        "usgs_record_start", "usgs_record_end",
        "cdcw_grain", "cdcw_window_start", "cdcw_window_end",
        "epht_threshold", "epht_metric", "epht_year_min", "epht_year_max",
        "gehe_record_start", "gehe_record_end",
        "ghcn_year_min", "ghcn_year_max",
        "spi_calibration", "drought_gov_window_start", "drought_gov_window_end",
        "usdm_year_min", "usdm_year_max",
        "nchs_year", "ruca_year", "rucc_year",
        "cvi_source_vintage", "svi_year", "tract_vintage",
    ),
}
SUFFIX_ROLES = {"coverage_flag": "_covered"}
LATE_EXACT_ROLES = {
    "derived_ever_flag": ("fod_ever", "mtbs_wildfire_ever", "nifc_wildfire_ever", "usgs_wildfire_ever")
}
DEFAULT_ROLE = "measurement"

NOT_USABLE = {
    "vintage_metadata": "describes the source's edition, not the zone",
    "identifier": "a key, not a signal",
}
USABLE_REASONS = {
    "geometry_measure": "size and position: isolation proxy and spatial statistics",
    "population": "needed to weight any disparity by people",
    "coverage_flag": "whether a measurement exists at all is itself a finding",
    "derived_ever_flag": "usable only together with its coverage flag, since false can mean no data",
    "identity_metadata": "names the matched entity; groups, not values",
}
DEFAULT_REASON = "a measurement with variance"

# Hypothesis tags.
ELIGIBILITY = "Measurement Eligibility Bias"
REACHABILITY = "Dispatch-Blind Reachability"
PROVENANCE = "Source Provenance x Vulnerability"
DOMINANCE = "Component Dominance"
EDGE_EFFECT = "Tribal Sub-type + Edge Effect"
EXPOSURE = "Population Exposure vs. Disparity"
PILLARS = "CVI Pillar Decomposition"
DISAGREEMENT = "RUCA/RUCC/NCHS Disagreement"

ROLE_TAGS = {
    "coverage_flag": (ELIGIBILITY,),
    "derived_ever_flag": (ELIGIBILITY, DOMINANCE),
    "geometry_measure": (EDGE_EFFECT, REACHABILITY),
    "population": (EXPOSURE, DOMINANCE, REACHABILITY),
}
GENERIC_TAGS = (ELIGIBILITY, PROVENANCE, DOMINANCE)
DOMAIN_TAGS = {
    **{domain: GENERIC_TAGS for domain in ("svi", "cvi", "wildfire", "heat", "drought")},
    "rurality": (*GENERIC_TAGS, REACHABILITY),
    "tribal": (*GENERIC_TAGS, REACHABILITY, EDGE_EFFECT, EXPOSURE),
}
COLUMN_TAGS = {
    ("identity_metadata", "aiannh_geoid"): (EDGE_EFFECT, EXPOSURE),
    ("identity_metadata", "aiannh_name"): (EDGE_EFFECT, EXPOSURE),
    ("identity_metadata", "uhe_city_name"): (PROVENANCE,),
    ("identity_metadata", "uhe_city_country"): (PROVENANCE,),
    **{
        ("measurement", c): (PILLARS,)
        for c in (
            "cvi_baseline",
            "cvi_climate",
            "cvi_baseline_health",
            "cvi_baseline_socioeconomic",
            "cvi_baseline_infrastructure",
            "cvi_baseline_environment",
            "cvi_climate_health",
            "cvi_climate_socioeconomic",
            "cvi_climate_extreme_events",
        )
    },
    **{
        ("measurement", c): (DISAGREEMENT,)
        for c in (
            "ruca_primary",
            "ruca_primary_desc",
            "ruca_secondary",
            "rucc_2023",
            "rucc_desc",
            "rucc_metro",
            "nchs_2013",
            "nchs_2013_label",
        )
    },
}


def role_rules(spark: SparkSession) -> DataFrame:
    """The role lists as a rule table, earlier rules first."""
    ordered = (
        [("exact", c, role) for role, columns in EXACT_ROLES.items() for c in columns]
        + [("suffix", suffix, role) for role, suffix in SUFFIX_ROLES.items()]
        + [("exact", c, role) for role, columns in LATE_EXACT_ROLES.items() for c in columns]
    )
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(ordered)], RULES_TYPE)


TAG_RULES_TYPE = "position int, role string, domain string, column_name string, tag string"


def tag_rules(spark: SparkSession) -> DataFrame:
    """The tag lists as a rule table; position keeps the order in which tags are listed."""
    rows = [(role, None, None, t) for role, tags in ROLE_TAGS.items() for t in tags]
    rows += [("measurement", domain, None, t) for domain, tags in DOMAIN_TAGS.items() for t in tags]
    rows += [(role, None, column, t) for (role, column), tags in COLUMN_TAGS.items() for t in tags]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], TAG_RULES_TYPE)


def table_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TABLE_DOMAINS.items()), "source_table string, domain string")


def column_domains(spark: SparkSession) -> DataFrame:
    rows = [(BACKBONE_TABLE, c, "population") for c in POPULATION_COLUMNS]
    return spark.createDataFrame(rows, "source_table string, column_name string, domain string")
