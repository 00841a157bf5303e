"""Gaps, scores, features and output.

Two inputs are used: the spatial layers (for the full ingredient build), and *customer
zones*: every customer is a zone whose raw counts are sums over its orders.  The latter has
one zone per customer, so undefined components arise by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlay.functions.gaps import (
    capped_ratio_gap,
    gap_defined,
    water_area_proxy,
    water_fraction,
)
from coverlay.operators import features as fe
from coverlay.operators.contracts import against_expected, contract_report
from coverlay.operators.features import onto_zones
from coverlay.operators.lineage import settle
from coverlay.operators.ordering import average_ranks, exact_quantiles
from coverlay.operators.profile import correlations, weighted_mean
from coverlay.plans import ingredients as ing
from coverlay.plans import scoring
from coverlay.plans.features import derived_columns, zone_features
from coverlay.queries import layers as L
from coverlay.queries.registry import query
from coverlay.queries.spatial import BOX_CENTRE, BOX_MEETS, CENTRE_IN, SQUARE_IN
from coverlay.sources.contracts import ZONE_FEATURES
from coverlay.sources.names import GAPS, OUTPUT_VALUES, RAW_COLUMNS

# --- spatial ingredients -------------------------------------------------------------------

CATEGORY = {
    "1-URGENT": "fire_department",
    "2-HIGH": "ambulance_and_ems_services",
    "3-MEDIUM": "elementary_school",
    "4-NOT SPECIFIED": "hospital",
    "5-LOW": "security_systems",
}
FACILITY_LEVEL = {"fire": "1-URGENT", "ems": "2-HIGH", "schools": "3-MEDIUM"}


def spatial_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """Every component of every zone: F orders observed, O orders reference, and so on."""
    index = L.zone_index(spark, d)
    roads = L.roads(spark, d).filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    transport = ing.transport_lengths(
        roads.filter("o_orderstatus = 'F'"),
        roads.filter("o_orderstatus = 'O'"),
        index,
        L.PLACE_ID,
        measure="planar",
    )
    b = L.footprints(spark, d)
    buildings = ing.building_counts(
        b.filter("l_returnflag = 'A'"), b.filter("l_returnflag = 'R'"), index, L.FOOTPRINT_ID, "planar"
    )
    p = L.places(spark, d)
    category = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])[F.col("o_orderpriority")]
    reference = p.filter("o_orderstatus = 'O'")
    facilities = {n: reference.filter(F.col("o_orderpriority") == v) for n, v in FACILITY_LEVEL.items()}
    places = ing.place_counts(p.filter("o_orderstatus = 'F'"), facilities, index, category)
    customers = L.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).count()
    withheld = F.when(F.col("region") != "AFRICA", F.coalesce("count", F.lit(0)))
    establishments = index.zones.join(customers, "n_nationkey", "left").select(
        "zone_id", withheld.alias("cbp_estab_bus")
    )
    return ing.zone_ingredients(index.zones.select("zone_id", "region"), transport, buildings, places, establishments)


def _gap_sql(observed: str, reference: str) -> str:
    return f"CASE WHEN {reference} > 0 THEN greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, {observed}::DOUBLE / {reference})) END"


def _gaps_sql(source: str) -> str:
    """All gap and flag columns over the raw columns of ``source``."""
    columns = []
    for gap, (flag, observed, reference) in GAPS.items():
        columns += [f"{_gap_sql(observed, reference)} AS {gap}", f"coalesce({reference} > 0, false) AS {flag}"]
    return f"SELECT *, {', '.join(columns)} FROM {source}"


SPATIAL_RAW = (
    L.layers_sql("z p b r lb")
    + f""", {BOX_CENTRE},
  road AS (SELECT zone_id, sum((t1 - t0) * sqrt(dx * dx + dy * dy)) FILTER (o_orderstatus = 'F') AS o,
      sum((t1 - t0) * sqrt(dx * dx + dy * dy)) FILTER (o_orderstatus = 'O') AS r
    FROM lb WHERE t1 - t0 > 1e-12 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1),
  cen AS (SELECT zone_id, count(*) FILTER (l_returnflag = 'A') AS o, count(*) FILTER (l_returnflag = 'R') AS r
    FROM z JOIN c ON {CENTRE_IN} GROUP BY 1),
  box AS (SELECT zone_id, count(*) FILTER (l_returnflag = 'A') AS o, count(*) FILTER (l_returnflag = 'R') AS r
    FROM z JOIN c ON {BOX_MEETS} GROUP BY 1),
  poi AS (SELECT zone_id,
      count(*) FILTER (o_orderstatus = 'F') AS n,
      count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS of,
      count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS rf,
      count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') AS oe,
      count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') AS re,
      count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM') AS os,
      count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM') AS rs
    FROM z JOIN p ON {SQUARE_IN} GROUP BY 1),
  raw AS (SELECT zone_id, region,
      coalesce(road.o, 0) AS overture_transport_length_m, coalesce(road.r, 0) AS tiger_transport_length_m,
      coalesce(cen.o, 0)::BIGINT AS overture_building_count_centroid, coalesce(box.o, 0)::BIGINT AS overture_building_count_intersection,
      coalesce(cen.r, 0)::BIGINT AS microsoft_building_count_centroid, coalesce(box.r, 0)::BIGINT AS microsoft_building_count_intersection,
      coalesce(of, 0)::BIGINT AS overture_poi_count_fire, coalesce(rf, 0)::BIGINT AS hifld_count_fire,
      coalesce(oe, 0)::BIGINT AS overture_poi_count_ems, coalesce(re, 0)::BIGINT AS hifld_count_ems,
      coalesce(os, 0)::BIGINT AS overture_poi_count_schools, coalesce(rs, 0)::BIGINT AS hifld_count_schools,
      coalesce(poi.n, 0)::BIGINT AS overture_places_count,
      CASE WHEN region <> 'AFRICA' THEN coalesce(cust.n, 0)::BIGINT END AS cbp_estab_bus
    FROM z LEFT JOIN road USING (zone_id) LEFT JOIN cen USING (zone_id) LEFT JOIN box USING (zone_id)
      LEFT JOIN poi USING (zone_id)
      LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) cust ON c_nationkey = n_nationkey)"""
)
LENGTHS = ("overture_transport_length_m", "tiger_transport_length_m")


def _rounded_sql(query_sql: str, columns, digits: int = 6, source: str = "g") -> str:
    kept = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({kept}) FROM ({query_sql}) {source}"


def _rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("zone_ingredients", SPATIAL_RAW + " " + _rounded_sql(_gaps_sql("raw"), [*LENGTHS, *GAPS], 4))
def zone_ingredients(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(spatial_ingredients(spark, d), [*LENGTHS, *GAPS], 4)


def _score_sql(building: str = "building_gap_centroid", flag: str = "building_gap_centroid_defined") -> str:
    """Scores from gaps: nested mean for places, then the mean of defined components."""
    half = """CASE WHEN poi_gap_fire_defined OR poi_gap_ems_defined OR poi_gap_schools_defined THEN
      (CASE WHEN poi_gap_fire_defined THEN poi_gap_fire ELSE 0 END + CASE WHEN poi_gap_ems_defined THEN poi_gap_ems ELSE 0 END
       + CASE WHEN poi_gap_schools_defined THEN poi_gap_schools ELSE 0 END)
      / (poi_gap_fire_defined::INT + poi_gap_ems_defined::INT + poi_gap_schools_defined::INT) END"""
    return f"""SELECT *, poi_gap IS NOT NULL AS poi_defined,
      (coalesce(transport_gap, 0) + coalesce(building_gap, 0) + coalesce(poi_gap, 0))
      / nullif((transport_gap IS NOT NULL)::INT + (building_gap IS NOT NULL)::INT + (poi_gap IS NOT NULL)::INT, 0) AS coverage_gap_score
    FROM (SELECT *, (coalesce(half, 0) + coalesce(est, 0)) / nullif((half IS NOT NULL)::INT + (est IS NOT NULL)::INT, 0) AS poi_gap
      FROM (SELECT *, {building} AS building_gap, {flag} AS building_defined, {half} AS half,
        CASE WHEN poi_gap_establishments_defined THEN poi_gap_establishments END AS est FROM gaps))"""


@query(
    "coverage_gap_score",
    SPATIAL_RAW
    + f", gaps AS ({_gaps_sql('raw')}), scored AS ({_score_sql()}) SELECT zone_id, region, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in ("transport_gap", "building_gap", "poi_gap", "coverage_gap_score"))
    + ", transport_defined, building_defined, poi_defined FROM scored",
)
def coverage_gap_score_query(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.score_zones(spatial_ingredients(spark, d), key="zone_id")
    numbers = ("transport_gap", "building_gap", "poi_gap", "coverage_gap_score")
    return _rounded(scored, numbers, 4).select(
        "zone_id", "region", *numbers, "transport_defined", "building_defined", "poi_defined"
    )


# --- customer zones ------------------------------------------------------------------------


def customer_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw columns per customer from its orders (F observed, O reference)."""
    status, level, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    seen, known = status == "F", status == "O"
    big = price > 200_000
    counts = {
        "overture_transport_length_m": F.sum(F.when(seen, price)),
        "tiger_transport_length_m": F.sum(F.when(known, price)),
        "overture_building_count_centroid": F.count_if(seen & big),
        "microsoft_building_count_centroid": F.count_if(known & big),
        "overture_building_count_intersection": F.count_if(seen),
        "microsoft_building_count_intersection": F.count_if(known),
        "overture_places_count": F.count(F.lit(1)),
    }
    for name, value in FACILITY_LEVEL.items():
        counts[f"overture_poi_count_{name}"] = F.count_if(seen & (level == value))
        counts[f"hifld_count_{name}"] = F.count_if(known & (level == value))
    orders = L.table(spark, d, "orders").groupBy("o_custkey").agg(*[c.alias(n) for n, c in counts.items()])
    zones = L.table(spark, d, "customer")
    names = L.table(spark, d, "region").join(
        L.table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    listed = zones.join(names, "c_nationkey").select(
        F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("GEOID"),
        "region",
        F.col("c_custkey").alias("o_custkey"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 500)).alias("cbp_estab_bus"),
    )
    return onto_zones(listed, [orders], "o_custkey", zero=RAW_COLUMNS).drop("o_custkey").select(
        "GEOID", "region", *RAW_COLUMNS, "cbp_estab_bus"
    )


def customer_strata(spark: SparkSession, d: str) -> DataFrame:
    """Strata per customer zone; not covered for one in ten, with a few exceptions."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    covered = key % 10 != 0
    c = L.table(spark, d, "customer")
    return c.select(
        F.lpad(key.cast("string"), 11, "0").alias("GEOID"),
        F.when(covered | (key % 50 == 0), balance).alias("svi_overall"),
        covered.alias("svi_covered"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("aiannh_geoid"),
        (key % 101).cast("double").alias("pct_urban"),
        F.when(key % 30 == 0, F.lit(-999.0)).otherwise((key % 1000).cast("double")).alias("pop_total"),
        F.col("c_mktsegment").alias("ur_class"),
    )


STRATA_QUERY_COLUMNS = ["svi_overall", "svi_covered", "aiannh_geoid", "pct_urban", "pop_total", "ur_class"]


def customer_features(spark: SparkSession, d: str) -> DataFrame:
    return zone_features(ing.candidate_gaps(customer_raw(spark, d)), customer_strata(spark, d), STRATA_QUERY_COLUMNS)


_FACILITY_SQL = ", ".join(
    f"count(*) FILTER (o_orderstatus = '{s}' AND o_orderpriority = '{v}')::BIGINT AS {prefix}_{n}"
    for n, v in FACILITY_LEVEL.items()
    for s, prefix in (("F", "overture_poi_count"), ("O", "hifld_count"))
)
CUSTOMER_SQL = f"""WITH o AS (SELECT o_custkey,
    sum(o_totalprice) FILTER (o_orderstatus = 'F') AS overture_transport_length_m,
    sum(o_totalprice) FILTER (o_orderstatus = 'O') AS tiger_transport_length_m,
    count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000)::BIGINT AS overture_building_count_centroid,
    count(*) FILTER (o_orderstatus = 'F')::BIGINT AS overture_building_count_intersection,
    count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000)::BIGINT AS microsoft_building_count_centroid,
    count(*) FILTER (o_orderstatus = 'O')::BIGINT AS microsoft_building_count_intersection,
    {_FACILITY_SQL}, count(*)::BIGINT AS overture_places_count FROM orders GROUP BY 1),
  raw AS (SELECT lpad(c_custkey::VARCHAR, 11, '0') AS GEOID, r_name AS region,
    {", ".join(f"coalesce({c}, 0) AS {c}" for c in RAW_COLUMNS)},
    CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 500)::BIGINT END AS cbp_estab_bus
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey),
  gaps AS ({_gaps_sql("raw")}),
  strata AS (SELECT lpad(c_custkey::VARCHAR, 11, '0') AS GEOID,
    CASE WHEN c_custkey % 10 <> 0 OR c_custkey % 50 = 0 THEN c_acctbal END AS svi_overall, c_custkey % 10 <> 0 AS svi_covered,
    CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS aiannh_geoid, (c_custkey % 101)::DOUBLE AS pct_urban,
    CASE WHEN c_custkey % 30 = 0 THEN -999.0::DOUBLE ELSE (c_custkey % 1000)::DOUBLE END AS pop_total, c_mktsegment AS ur_class FROM customer),
  scored AS ({_score_sql()})"""
_STATION = "(coalesce(poi_gap_fire, 0) + coalesce(poi_gap_ems, 0)) / nullif((poi_gap_fire IS NOT NULL)::INT + (poi_gap_ems IS NOT NULL)::INT, 0)"
_DISPATCH_SQL = f"""SELECT *, CASE WHEN transport_gap > 0.5 AND st > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dispatch_blind_threshold_and,
    round(sqrt(transport_gap * transport_gap + st * st) / sqrt(2.0::DOUBLE), 6) AS dispatch_blind_normalized_euclidean,
    round(transport_gap * st, 6) AS dispatch_blind_product, round(1 - (1 - transport_gap) * (1 - st), 6) AS dispatch_blind_dari
  FROM (SELECT *, {_STATION} AS st FROM gaps)"""
_BIG = "greatest(" + ", ".join(GAPS) + ")"
_DOMINANT_SQL = (
    "CASE " + " ".join(f"WHEN {g} = {_BIG} THEN '{g}'" for g in GAPS) + " END AS dominant_component, ("
    + " + ".join(f"{f}::INT" for f, _, _ in GAPS.values()) + ")::INT AS n_components_defined, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT {f} THEN '{g}' END" for g, (f, _, _) in GAPS.items()) + ") AS undefined_components"
)


@query(
    "capped_ratio_gap",
    CUSTOMER_SQL
    + f""" SELECT GEOID, round({_gap_sql('overture_places_count', 'cbp_estab_bus')}, 6) AS gap,
      coalesce(cbp_estab_bus > 0, false) AS defined FROM raw""",
)
def capped_ratio_gap_query(spark: SparkSession, d: str) -> DataFrame:
    raw = customer_raw(spark, d)
    gap = capped_ratio_gap("overture_places_count", "cbp_estab_bus")
    return raw.select("GEOID", F.round(gap, 6).alias("gap"), gap_defined("cbp_estab_bus").alias("defined"))


@query("candidate_gaps", CUSTOMER_SQL + " " + _rounded_sql("SELECT * FROM gaps", [*LENGTHS, *GAPS]))
def candidate_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ing.candidate_gaps(customer_raw(spark, d)), [*LENGTHS, *GAPS])


SCORE_NUMBERS = ("transport_gap", "building_gap", "poi_gap", "coverage_gap_score")


@query(
    "score_all_regions",
    CUSTOMER_SQL
    + " SELECT GEOID, region, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_NUMBERS)
    + ", building_defined, poi_defined FROM scored",
)
def score_all_regions(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.score_zones(customer_features(spark, d))
    return _rounded(scored, SCORE_NUMBERS).select("GEOID", "region", *SCORE_NUMBERS, "building_defined", "poi_defined")


OTHER_RULE = "building_gap_intersection"


@query(
    "building_rule_variants",
    CUSTOMER_SQL
    + f""", asia AS ({_score_sql("CASE WHEN region = 'ASIA' THEN building_gap_intersection ELSE building_gap_centroid END")}),
      everywhere AS ({_score_sql("building_gap_intersection")}),
      v AS (SELECT 'baseline' AS variant, GEOID, region, coverage_gap_score FROM scored
        UNION ALL SELECT 'asia', GEOID, region, coverage_gap_score FROM asia
        UNION ALL SELECT 'everywhere', GEOID, region, coverage_gap_score FROM everywhere)
      SELECT variant, v.region, round(avg(v.coverage_gap_score), 6) AS mean_score,
        round(avg(abs(v.coverage_gap_score - b.coverage_gap_score)), 6) AS mean_abs_delta,
        round(max(abs(v.coverage_gap_score - b.coverage_gap_score)), 6) AS max_abs_delta
      FROM v JOIN scored b USING (GEOID) GROUP BY ALL""",
)
def building_rule_variants(spark: SparkSession, d: str) -> DataFrame:
    regions = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    variants = {"baseline": {}, "asia": {"ASIA": OTHER_RULE}, "everywhere": {r: OTHER_RULE for r in regions}}
    deltas = scoring.region_deltas(scoring.compare_rules(settle(customer_features(spark, d)), variants, "baseline"))
    return _rounded(deltas, ("mean_score", "mean_abs_delta", "max_abs_delta"))


_OUTPUT_SQL = """SELECT GEOID, coalesce(coverage_gap_score, 0) AS coverage_gap_score, region,
    coalesce(transport_gap, 0) AS transport_gap, transport_defined, coalesce(building_gap, 0) AS building_gap, building_defined,
    coalesce(poi_gap, 0) AS poi_gap, poi_defined, coalesce(poi_gap_fire, 0) AS poi_gap_fire, poi_gap_fire_defined AS poi_defined_fire,
    coalesce(poi_gap_ems, 0) AS poi_gap_ems, poi_gap_ems_defined AS poi_defined_ems, coalesce(poi_gap_schools, 0) AS poi_gap_schools,
    poi_gap_schools_defined AS poi_defined_schools, coalesce(poi_gap_establishments, 0) AS poi_gap_cbp,
    poi_gap_establishments_defined AS poi_defined_cbp FROM scored"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return customer_raw(spark, d).select("GEOID", "region")


@query("output_table", CUSTOMER_SQL + " " + _rounded_sql(_OUTPUT_SQL, OUTPUT_VALUES))
def output_table(spark: SparkSession, d: str) -> DataFrame:
    scored = settle(scoring.score_zones(customer_features(spark, d)))
    return _rounded(scoring.build_output(scored, _manifest(spark, d)), OUTPUT_VALUES)


@query(
    "placeholder_output",
    CUSTOMER_SQL
    + " SELECT GEOID, region, "
    + ", ".join(f"0.5::DOUBLE AS {c}" for c in OUTPUT_VALUES)
    + ", " + ", ".join(f"true AS {c}" for c in ("transport_defined", "building_defined", "poi_defined", "poi_defined_fire", "poi_defined_ems", "poi_defined_schools", "poi_defined_cbp"))
    + " FROM raw",
)
def placeholder_output(spark: SparkSession, d: str) -> DataFrame:
    return scoring.placeholder_output(_manifest(spark, d))


@query(
    "validate_output",
    """WITH c AS (SELECT c_custkey, c_acctbal FROM customer), n AS (SELECT count(*) AS n FROM c),
      u AS (SELECT c_custkey FROM c WHERE c_acctbal < 0), h AS (SELECT c_custkey FROM c WHERE c_acctbal > 9000)
    SELECT 1 AS position, 'row count' AS check_name, (SELECT count(*) FROM u)::BIGINT AS violations
    UNION ALL SELECT 2, 'rows per region', (SELECT count(DISTINCT r_name) FROM c JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c.c_acctbal < 0)::BIGINT
    UNION ALL SELECT 3, 'unknown keys', 0
    UNION ALL SELECT 4, 'missing keys', (SELECT count(*) FROM u)::BIGINT
    UNION ALL SELECT 5, 'blank cells', 0
    UNION ALL SELECT 6, 'outside [0, 1]', (SELECT count(*) FROM h)::BIGINT""",
)
def validate_output(spark: SparkSession, d: str) -> DataFrame:
    """The checks on a damaged output: some zones lost, some scores out of range."""
    balance = L.table(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("GEOID"), "c_acctbal"
    )
    manifest = _manifest(spark, d)
    damaged = (
        scoring.placeholder_output(manifest)
        .join(balance, "GEOID")
        .filter("c_acctbal >= 0")
        .withColumn("coverage_gap_score", F.when(F.col("c_acctbal") > 9000, F.lit(1.5)).otherwise(F.lit(0.5)))
    )
    return scoring.output_report(damaged, manifest)


@query(
    "zone_feature_table",
    CUSTOMER_SQL
    + f" SELECT GEOID, region, svi_overall, svi_covered, aiannh_geoid, pct_urban, pop_total, ur_class, {_DOMINANT_SQL}, "
    + ", ".join(["dispatch_blind_threshold_and", "dispatch_blind_normalized_euclidean", "dispatch_blind_product", "dispatch_blind_dari"])
    + f" FROM ({_DISPATCH_SQL}) LEFT JOIN strata USING (GEOID)",
)
def zone_feature_table(spark: SparkSession, d: str) -> DataFrame:
    numbers = ("dispatch_blind_normalized_euclidean", "dispatch_blind_product", "dispatch_blind_dari")
    return _rounded(customer_features(spark, d), numbers).select(
        "GEOID", "region", *STRATA_QUERY_COLUMNS, "dominant_component", "n_components_defined", "undefined_components",
        "dispatch_blind_threshold_and", *numbers,
    )


@query(
    "feature_contract",
    CUSTOMER_SQL
    + """, f AS (SELECT *, poi_gap_fire - 0.5 AS shifted FROM gaps)
    SELECT 'GEOID' AS column_name, '11 digits' AS check_name, 0::BIGINT AS violations
    UNION ALL SELECT 'poi_gap_fire', 'in [0, 1]', count(*) FILTER (shifted < 0)::BIGINT FROM f
    UNION ALL SELECT 'cbp_estab_bus', '>= 0', 0
    UNION ALL SELECT 'transport_gap', 'in [0, 1]', 0""",
)
def feature_contract(spark: SparkSession, d: str) -> DataFrame:
    """Contract counts on a table whose fire gaps are shifted out of range."""
    shifted = ing.candidate_gaps(customer_raw(spark, d)).withColumn("poi_gap_fire", F.col("poi_gap_fire") - 0.5)
    report = contract_report(derived_columns(shifted), ZONE_FEATURES)
    shown = (
        ((F.col("column_name") == "GEOID") & (F.col("check_name") == "11 digits"))
        | ((F.col("column_name") == "cbp_estab_bus") & (F.col("check_name") == ">= 0"))
        | F.col("column_name").isin("poi_gap_fire", "transport_gap")
    )
    return report.filter(shown)


# --- features and statistics ---------------------------------------------------------------

DATASET_SQL = """CASE event_type WHEN 'view' THEN 'OpenStreetMap' WHEN 'click' THEN 'Microsoft ML Buildings'
  WHEN 'purchase' THEN 'Google Open Buildings' WHEN 'signup' THEN 'USGS Lidar' ELSE 'TomTom' END"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Events as map records: user = zone, a dataset name, a confidence some lack."""
    names = {
        "view": "OpenStreetMap",
        "click": "Microsoft ML Buildings",
        "purchase": "Google Open Buildings",
        "signup": "USGS Lidar",
    }
    dataset = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("event_type")), F.lit("TomTom")
    )
    return L.table(spark, d, "events").select(
        F.col("user_id").alias("zone"),
        "event_id",
        "event_type",
        dataset.alias("dataset"),
        F.when(F.col("event_type") != "error", F.col("value") / 500).alias("confidence"),
        "props",
    )


@query(
    "confidence_features",
    """SELECT user_id AS zone, round(count(c)::DOUBLE / count(*), 9) AS confidence_reporting_rate, round(avg(c), 9) AS mean_reported_confidence
    FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value / 500 END AS c FROM events) GROUP BY ALL""",
)
def confidence_features(spark: SparkSession, d: str) -> DataFrame:
    f = fe.confidence_features(records(spark, d), "zone", "confidence")
    return _rounded(f, ("confidence_reporting_rate", "mean_reported_confidence"), 9)


@query(
    "source_provenance",
    f"""WITH n AS (SELECT user_id AS zone, {DATASET_SQL} AS ds, count(*) AS n FROM events GROUP BY ALL),
      t AS (SELECT *, sum(n) OVER (PARTITION BY zone) AS total FROM n)
    SELECT zone, round(sum(CASE WHEN ds = 'OpenStreetMap' THEN n ELSE 0 END) / any_value(total), 6)::DOUBLE AS osm_share,
      round(sum(CASE WHEN contains(ds, 'Microsoft') THEN n ELSE 0 END) / any_value(total), 6)::DOUBLE AS microsoft_share,
      round(sum(CASE WHEN contains(ds, 'Google') THEN n ELSE 0 END) / any_value(total), 6)::DOUBLE AS google_share,
      round(sum(CASE WHEN ds IN ('USGS Lidar', 'TomTom') THEN n ELSE 0 END) / any_value(total), 6)::DOUBLE AS other_share,
      any_value(total)::BIGINT AS n_sources, arg_max(ds, n * 1000 - ascii(ds)) AS dominant_source,
      round(-sum(n::DOUBLE / total * ln(n::DOUBLE / total)), 6) AS source_entropy FROM t GROUP BY zone""",
)
def source_provenance(spark: SparkSession, d: str) -> DataFrame:
    f = fe.source_provenance(records(spark, d), "zone", "dataset")
    return _rounded(f, ("osm_share", "microsoft_share", "google_share", "other_share", "source_entropy"))


_REGION_SQL = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_FLAGS_SQL = """flags AS (SELECT s.GEOID, raw.region, aiannh_geoid IS NOT NULL AS is_tribal, pct_urban < 50 AS is_rural,
      CASE WHEN svi_covered THEN svi_overall END AS v FROM strata s JOIN raw USING (GEOID)),
  med AS (SELECT region, quantile_cont(v, 0.5) AS m FROM flags GROUP BY 1)"""


@query(
    "strata_flags",
    CUSTOMER_SQL
    + f", {_FLAGS_SQL} SELECT GEOID, flags.region, is_tribal, is_rural, v >= m AS is_high_vulnerability FROM flags JOIN med USING (region)",
)
def strata_flags(spark: SparkSession, d: str) -> DataFrame:
    return fe.strata_flags(customer_strata(spark, d).join(_manifest(spark, d), "GEOID"))


QUOTAS = {"AFRICA": 3, "AMERICA": 2, "ASIA": 2, "EUROPE": 3, "MIDDLE EAST": 4}
_PICK_STEPS = """
  k AS (SELECT f.*, s.coverage_gap_score AS score, GEOID IN (SELECT lpad(c_custkey::VARCHAR, 11, '0') FROM customer WHERE c_acctbal > 9950) AS is_water,
      CASE f.region WHEN 'AFRICA' THEN 3 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS quota
    FROM flags f JOIN scored s USING (GEOID)),
  p1 AS (SELECT region, any_value(quota) AS quota, min(GEOID) FILTER (is_water) AS w FROM k GROUP BY 1),
  p2 AS (SELECT p1.*, (SELECT min(GEOID) FROM k WHERE k.region = p1.region AND is_tribal AND GEOID IS DISTINCT FROM w) AS t FROM p1),
  p3 AS (SELECT p2.*, CASE WHEN (w IS NOT NULL)::INT + (t IS NOT NULL)::INT < quota THEN
      (SELECT min(GEOID) FROM k WHERE k.region = p2.region AND is_rural AND GEOID IS DISTINCT FROM w AND GEOID IS DISTINCT FROM t) END AS r FROM p2),
  p4 AS (SELECT p3.*, CASE WHEN (w IS NOT NULL)::INT + (t IS NOT NULL)::INT + (r IS NOT NULL)::INT < quota THEN
      (SELECT min(GEOID) FROM k WHERE k.region = p3.region AND NOT is_rural AND GEOID IS DISTINCT FROM w AND GEOID IS DISTINCT FROM t AND GEOID IS DISTINCT FROM r) END AS u FROM p3),
  picked AS (SELECT region, GEOID, ord, NULL::DOUBLE AS score FROM (SELECT region, w AS GEOID, 1 AS ord FROM p4 UNION ALL SELECT region, t, 2 FROM p4
      UNION ALL SELECT region, r, 3 FROM p4 UNION ALL SELECT region, u, 4 FROM p4) WHERE GEOID IS NOT NULL),
  rest AS (SELECT k.region, GEOID, 5 AS ord, score FROM k WHERE GEOID NOT IN (SELECT GEOID FROM picked)),
  ranked AS (SELECT region, GEOID, row_number() OVER (PARTITION BY region ORDER BY ord, score DESC NULLS LAST, GEOID) AS position
    FROM (SELECT * FROM picked UNION ALL SELECT * FROM rest))"""


@query(
    "stratified_pick",
    CUSTOMER_SQL
    + f", {_FLAGS_SQL}, {_PICK_STEPS} SELECT ranked.region, position::INT AS position, GEOID FROM ranked JOIN p1 USING (region) WHERE position <= quota",
)
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    water = L.table(spark, d, "customer").filter("c_acctbal > 9950").select(
        F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("GEOID"), F.lit(True).alias("w")
    )
    scored = scoring.score_zones(customer_features(spark, d)).select("GEOID", F.col("coverage_gap_score").alias("score"))
    flags = strata_flags(spark, d).join(scored, "GEOID").join(water, "GEOID", "left")
    return fe.stratified_pick(flags.withColumn("is_water", F.coalesce("w", F.lit(False))), QUOTAS)


@query(
    "weighted_gap",
    CUSTOMER_SQL
    + """ SELECT region, round(sum(transport_gap * pop_total) / sum(pop_total), 6) AS weighted_mean, count(*)::BIGINT AS n_used
      FROM gaps JOIN strata USING (GEOID) WHERE transport_gap IS NOT NULL AND pop_total > 0 GROUP BY ALL""",
)
def weighted_gap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(weighted_mean(customer_features(spark, d), "transport_gap", "pop_total", ["region"]), ["weighted_mean"])


@query(
    "component_correlation",
    CUSTOMER_SQL
    + """ SELECT 'overture_transport_length_m' AS left_column, 'overture_building_count_intersection' AS right_column,
        round(corr(overture_transport_length_m, overture_building_count_intersection), 6) AS corr FROM raw
      UNION ALL SELECT 'overture_transport_length_m', 'overture_places_count', round(corr(overture_transport_length_m, overture_places_count), 6) FROM raw
      UNION ALL SELECT 'overture_building_count_intersection', 'overture_places_count', round(corr(overture_building_count_intersection, overture_places_count), 6) FROM raw""",
)
def component_correlation(spark: SparkSession, d: str) -> DataFrame:
    columns = ["overture_transport_length_m", "overture_building_count_intersection", "overture_places_count"]
    return _rounded(correlations(customer_raw(spark, d), columns), ["corr"])


@query(
    "avg_rank_shift",
    CUSTOMER_SQL
    + """, q AS (SELECT GEOID,
        CASE WHEN building_gap_centroid IS NOT NULL THEN rank() OVER (PARTITION BY building_gap_centroid IS NULL ORDER BY building_gap_centroid)
          + (count(*) OVER (PARTITION BY building_gap_centroid) - 1) / 2.0::DOUBLE END AS a,
        CASE WHEN building_gap_intersection IS NOT NULL THEN rank() OVER (PARTITION BY building_gap_intersection IS NULL ORDER BY building_gap_intersection)
          + (count(*) OVER (PARTITION BY building_gap_intersection) - 1) / 2.0::DOUBLE END AS b FROM gaps)
      SELECT count(a - b)::BIGINT AS n, round(avg(abs(a - b)), 4) AS mean_shift, max(abs(a - b)) AS max_shift FROM q""",
)
def avg_rank_shift(spark: SparkSession, d: str) -> DataFrame:
    gaps = ing.candidate_gaps(customer_raw(spark, d)).select("GEOID", "building_gap_centroid", "building_gap_intersection")
    ranked = average_ranks(settle(gaps), {"building_gap_centroid": "a", "building_gap_intersection": "b"})
    shift = F.abs(F.col("a") - F.col("b"))
    return ranked.agg(F.count(shift).alias("n"), F.round(F.avg(shift), 4).alias("mean_shift"), F.max(shift).alias("max_shift"))


@query(
    "housing_ratio",
    """WITH o AS (SELECT o_custkey, count(*) AS units, count(*) FILTER (o_orderstatus = 'F') AS built FROM orders GROUP BY 1),
      j AS (SELECT r_name AS region, units, built, units / nullif(built, 0)::DOUBLE AS ratio FROM """
    + _REGION_SQL
    + """ JOIN o ON o_custkey = c_custkey)
    SELECT region, quantile_cont(units, 0.5)::DOUBLE AS median_units, quantile_cont(built, 0.5)::DOUBLE AS median_buildings,
      round(quantile_cont(ratio, 0.5), 6) AS median_ratio FROM j GROUP BY ALL""",
)
def housing_ratio(spark: SparkSession, d: str) -> DataFrame:
    raw = customer_raw(spark, d).filter("overture_places_count > 0")
    built = F.col("overture_building_count_intersection")
    ratio = F.when(built != 0, F.col("overture_places_count") / built)
    data = settle(raw.select("region", F.col("overture_places_count").alias("u"), built.alias("b"), ratio.alias("r")))
    medians = [
        exact_quantiles(data, column, {name: 0.5}, ["region"])
        for column, name in (("u", "median_units"), ("b", "median_buildings"), ("r", "median_ratio"))
    ]
    return _rounded(medians[0].join(medians[1], "region").join(medians[2], "region"), ["median_ratio"])


@query(
    "ratio_band",
    CUSTOMER_SQL
    + """, s AS (SELECT region, sum(overture_transport_length_m) AS o, sum(tiger_transport_length_m) AS r FROM raw GROUP BY 1)
      SELECT region, round(o, 2) AS observed, round(r, 2) AS reference, round(o / r, 6) AS ratio, round(r / o, 6) AS inverse_ratio,
        o / r BETWEEN 0.71 AND 1.59 AS in_band FROM s""",
)
def ratio_band(spark: SparkSession, d: str) -> DataFrame:
    band = scoring.ratio_band(customer_raw(spark, d), "overture_transport_length_m", "tiger_transport_length_m")
    return _rounded(_rounded(band, ("observed", "reference"), 2), ("ratio", "inverse_ratio"))


@query(
    "over_count_ratio",
    """WITH a AS (SELECT l_linenumber, count(*) AS o FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
      b AS (SELECT l_linenumber, count(*) AS r FROM lineitem WHERE l_discount > 0.08 GROUP BY 1)
    SELECT l_linenumber, coalesce(o, 0)::BIGINT AS observed, coalesce(r, 0)::BIGINT AS reference,
      round(o / r::DOUBLE, 6) AS ratio, coalesce(o / r::DOUBLE > 3, false) AS over_counted FROM a FULL JOIN b USING (l_linenumber)""",
)
def over_count_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = L.table(spark, d, "lineitem")
    return _rounded(scoring.over_count(t.filter("l_returnflag <> 'N'"), t.filter("l_discount > 0.08"), "l_linenumber"), ["ratio"])


@query(
    "undefined_share",
    CUSTOMER_SQL
    + """ SELECT region, round(100.0::DOUBLE * avg((NOT (transport_defined AND building_defined AND poi_defined))::INT), 6) AS pct_any_undefined
      FROM scored GROUP BY ALL""",
)
def undefined_share(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.any_undefined_share(scoring.score_zones(customer_features(spark, d))), ["pct_any_undefined"])


@query(
    "flag_mismatch",
    CUSTOMER_SQL
    + """ SELECT 'transport_defined' AS column_name, count(*) FILTER (transport_defined IS DISTINCT FROM (overture_transport_length_m > 0))::BIGINT AS mismatches FROM gaps
      UNION ALL SELECT 'poi_gap_fire', count(*) FILTER (poi_gap_fire IS DISTINCT FROM CASE WHEN hifld_count_fire > 1 THEN poi_gap_fire END)::BIGINT FROM gaps""",
)
def flag_mismatch(spark: SparkSession, d: str) -> DataFrame:
    stored = ing.candidate_gaps(customer_raw(spark, d))
    other = stored.withColumns(
        {
            "transport_defined": F.col("overture_transport_length_m") > 0,
            "poi_gap_fire": F.when(F.col("hifld_count_fire") > 1, F.col("poi_gap_fire")),
        }
    )
    return scoring.flag_mismatches(stored, other, "GEOID", ["transport_defined", "poi_gap_fire"])


@query(
    "known_answers",
    CUSTOMER_SQL
    + """, m AS (SELECT region, count(*) FILTER (NOT transport_defined) AS n FROM gaps GROUP BY 1),
      x AS (SELECT r_name AS region, count(*) FILTER (c_acctbal < 0) AS e FROM """
    + _REGION_SQL
    + """ GROUP BY 1)
      SELECT region, n::BIGINT AS measured, e::BIGINT AS expected, (n - e)::DOUBLE AS difference, abs(n - e) <= 5 AS passed FROM m FULL JOIN x USING (region)""",
)
def known_answers(spark: SparkSession, d: str) -> DataFrame:
    raw = customer_raw(spark, d)
    flagged = raw.withColumn("ok", gap_defined("tiger_transport_length_m"))
    measured = flagged.groupBy("region").agg(F.count_if(~F.col("ok")).alias("n"))
    expected = raw.groupBy("region").agg(F.count_if(F.col("cbp_estab_bus").isNull()).alias("expected"))
    return against_expected(measured, expected, "region", "n", tolerance=5)


@query(
    "water_fraction",
    """WITH w AS (SELECT r_name AS region, (c_custkey % 97)::DOUBLE AS land, greatest(c_acctbal, 0) / 100 AS water,
        greatest((c_custkey % 97) * 1.5::DOUBLE + c_acctbal / 200 - (c_custkey % 97), 0) AS proxy FROM """
    + _REGION_SQL
    + """), f AS (SELECT region, CASE WHEN land + water <> 0 THEN water / (land + water) END AS a, CASE WHEN land + proxy <> 0 THEN proxy / (land + proxy) END AS b FROM w)
    SELECT region, count(*) FILTER (a > 0.5)::BIGINT AS water_dominated, round(avg(a), 6) AS mean_fraction,
      count(*) FILTER (a IS NULL)::BIGINT AS undefined, count(*) FILTER (b > 0.5)::BIGINT AS proxy_dominated, round(avg(b), 6) AS proxy_mean FROM f GROUP BY ALL""",
)
def water_fraction_query(spark: SparkSession, d: str) -> DataFrame:
    names = L.table(spark, d, "nation").join(L.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = L.table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    land = (F.col("c_custkey") % 97).cast("double")
    w = c.select(
        F.col("r_name").alias("region"),
        land.alias("land"),
        (F.greatest("c_acctbal", F.lit(0.0)) / 100).alias("water"),
        water_area_proxy(land * 1.5 + F.col("c_acctbal") / 200, land).alias("proxy"),
    )
    f = w.select("region", water_fraction("land", "water").alias("a"), water_fraction("land", "proxy").alias("b"))
    return f.groupBy("region").agg(
        F.count_if(F.col("a") > 0.5).alias("water_dominated"),
        F.round(F.avg("a"), 6).alias("mean_fraction"),
        F.count_if(F.col("a").isNull()).alias("undefined"),
        F.count_if(F.col("b") > 0.5).alias("proxy_dominated"),
        F.round(F.avg("b"), 6).alias("proxy_mean"),
    )
