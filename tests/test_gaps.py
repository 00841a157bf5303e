"""Gap arithmetic, scores, features and output."""

import pytest
from pyspark.sql import functions as F

from coverlay.functions import gaps
from coverlay.operators import features as fe
from coverlay.operators.contracts import ContractViolation, enforce, select_allowed, with_roles
from coverlay.plans import ingredients as ing
from coverlay.plans import scoring
from coverlay.plans.features import derived_columns, join_strata
from coverlay.sources.contracts import ZONE_FEATURES
from coverlay.sources.names import COLUMN_ROLES, GAPS, OUTPUT_COLUMNS, RAW_COLUMNS, STRATA_COLUMNS


@pytest.mark.parametrize(
    "observed,reference,gap",
    [(0, 100, 1.0), (100, 100, 0.0), (150, 100, 0.0), (0, 0, None), (5, 0, None), (30, 40, 0.25), (5, None, None), (None, 5, None), (5, float("nan"), None), (5, -1, None)],
)
def test_capped_ratio(spark, observed, reference, gap):
    df = spark.createDataFrame([(None if observed is None else float(observed), None if reference is None else float(reference))], "o double, r double")
    got = df.select(gaps.capped_ratio_gap("o", "r"), gaps.gap_defined("r")).first()
    assert got[0] == gap
    assert got[1] is (reference is not None and reference == reference and reference > 0)


@pytest.mark.parametrize("parts,score", [((0.25, 0.75, None), 0.5), ((0.2, 0.4, 0.6), 0.4), ((None, None, None), None)])
def test_composite_is_mean_of_defined(spark, parts, score):
    df = spark.createDataFrame([parts], "a double, b double, c double")
    got = df.select(gaps.coverage_gap_score("a", "b", "c")).first()[0]
    assert got == (None if score is None else pytest.approx(score))


@pytest.mark.parametrize(
    "row,gap",
    [
        (((0.2, True), (0.4, True), (0.6, True), (0.8, True)), 0.6),
        (((0.3, True), (0.0, False), (0.0, False), (0.0, False)), 0.3),
        (((0.0, False), (0.0, False), (0.0, False), (0.7, True)), 0.7),
        (((0.0, False), (0.0, False), (0.0, False), (0.0, False)), None),
    ],
)
def test_nested_poi_mean(spark, row, gap):
    flat = [v for pair in row for v in pair]
    df = spark.createDataFrame([flat], "f double, fd boolean, e double, ed boolean, s double, sd boolean, c double, cd boolean")
    value, defined = gaps.nested_poi_gap({"f": "fd", "e": "ed", "s": "sd"}, ("c", "cd"))
    got = df.select(value, defined).first()
    assert got[0] == (None if gap is None else pytest.approx(gap)) and got[1] is (gap is not None)


def test_dispatch_blind_bounds_and_null_rule(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.6, 0.8), (3, 0.0, 0.0), (4, None, 0.9)], "i int, t double, p double")
    cols = gaps.dispatch_blind("t", "p")
    rows = {r["i"]: r for r in df.select("i", *[c.alias(n) for n, c in cols.items()]).collect()}
    assert [rows[i]["dispatch_blind_normalized_euclidean"] for i in (1, 2, 3)] == pytest.approx([1.0, 0.70710678, 0.0])
    assert all(0 <= rows[i][n] <= 1 for i in (1, 2, 3) for n in cols)
    assert rows[4]["dispatch_blind_threshold_and"] == 0.0 and rows[4]["dispatch_blind_product"] is None


def test_component_dominance(spark):
    schema = "i int, a double, b double, c double, fa boolean, fb boolean, fc boolean"
    df = spark.createDataFrame([(1, 0.8, 0.3, 0.5, True, True, True), (2, None, None, None, False, False, False), (3, 0.5, 0.5, 0.1, True, True, False)], schema)
    cols = gaps.component_dominance(["a", "b", "c"], {"a": "fa", "b": "fb", "c": "fc"})
    rows = {r["i"]: tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in cols.items()]).collect()}
    assert rows == {1: ("a", 3, ""), 2: (None, 0, "a,b,c"), 3: ("a", 2, "c")}


def test_water_and_clip(spark):
    df = spark.createDataFrame([(1, 10.0, 30.0), (2, 0.0, 0.0), (3, None, 5.0)], "i int, land double, water double")
    rows = df.select("i", gaps.water_fraction("land", "water"), gaps.clip("land", 1, 5)).orderBy("i").collect()
    assert [r[1] for r in rows] == [0.75, None, None] and [r[2] for r in rows] == [5.0, 1.0, None]
    assert df.select(gaps.water_area_proxy(F.lit(9.0), "land")).collect()[0][0] == 0.0


def feature_rows(spark):
    raw = [("00000000001", "r1", 50.0, 100.0, 3, 9, 4, 10, 1, 2, 0, 0, 1, 1, 7, 10), ("00000000002", "r2", 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, None)]
    columns = ["GEOID string", "region string", *[f"{c} double" for c in RAW_COLUMNS], "cbp_estab_bus int"]
    data = [(*r[:2], *[float(v) for v in r[2:-1]], r[-1]) for r in raw]
    return spark.createDataFrame(data, ", ".join(columns))


def strata_rows(spark):
    names = ", ".join(f"{c} double" for c in STRATA_COLUMNS)
    return spark.createDataFrame([("00000000001", *[1.0] * len(STRATA_COLUMNS))], f"GEOID string, {names}")


def test_feature_table_contract_and_scores(spark):
    features = derived_columns(join_strata(ing.candidate_gaps(feature_rows(spark)), strata_rows(spark), STRATA_COLUMNS, "GEOID"))
    assert len(STRATA_COLUMNS) == 63
    enforce(features, ZONE_FEATURES)
    rows = {r["GEOID"]: r for r in scoring.score_zones(features).collect()}
    first = rows["00000000001"]
    assert first["transport_gap"] == 0.5 and first["building_gap"] == pytest.approx(1 - 3 / 4)
    assert first["poi_gap"] == pytest.approx(((0.5 + 0.0) / 2 + 0.3) / 2)
    assert first["coverage_gap_score"] == pytest.approx((0.5 + 0.25 + first["poi_gap"]) / 3)
    assert rows["00000000002"]["coverage_gap_score"] is None and rows["00000000002"]["poi_defined"] is False
    other = scoring.score_zones(features, {"r1": "building_gap_intersection"}).filter("region = 'r1'").first()
    assert other["building_gap"] == pytest.approx(1 - 9 / 10)


def test_rule_variants_leave_other_regions_alone(spark):
    features = ing.candidate_gaps(feature_rows(spark))
    rows = scoring.compare_rules(features, {"base": {}, "r1": {"r1": "building_gap_intersection"}}, "base").collect()
    delta = {(r["variant"], r["GEOID"]): r["delta"] for r in rows}
    assert delta[("base", "00000000001")] == 0.0 and delta[("r1", "00000000001")] < 0
    assert delta[("r1", "00000000002")] is None


def test_missing_strata_column_is_named(spark):
    with pytest.raises(ContractViolation, match="pop_total"):
        join_strata(feature_rows(spark), strata_rows(spark).drop("pop_total"), STRATA_COLUMNS, "GEOID")


def test_role_gate_is_fail_closed(spark):
    features = with_roles(ing.candidate_gaps(feature_rows(spark)).withColumn("svi_overall", F.lit(1.0)), COLUMN_ROLES)
    assert select_allowed(features, ["transport_gap"], "competition", ["GEOID"]).columns == ["GEOID", "transport_gap"]
    for name in ("svi_overall", "cbp_estab_bus"):
        with pytest.raises(ContractViolation, match=name):
            select_allowed(features, ["transport_gap", name], "competition")


def output_fixture(spark):
    manifest = spark.createDataFrame([("A", "r1"), ("B", "r1"), ("C", "r2")], "GEOID string, region string")
    return manifest, scoring.placeholder_output(manifest)


def test_clean_output_passes(spark):
    manifest, output = output_fixture(spark)
    assert scoring.validate_output(output, manifest).columns == list(OUTPUT_COLUMNS)


@pytest.mark.parametrize(
    "damage,message",
    [
        (lambda o: o.drop("poi_gap"), "poi_gap"),
        (lambda o: o.filter("GEOID <> 'A'"), "row count"),
        (lambda o: o.withColumn("region", F.lit("r1")), "rows per region"),
        (lambda o: o.withColumn("GEOID", F.when(F.col("GEOID") == "A", "Z").otherwise(F.col("GEOID"))), "unknown keys"),
        (lambda o: o.withColumn("poi_gap", F.when(F.col("GEOID") != "A", F.col("poi_gap"))), "blank cells"),
        (lambda o: o.withColumn("poi_gap", F.lit(1.5)), "outside"),
    ],
)
def test_damaged_output_fails(spark, damage, message):
    manifest, output = output_fixture(spark)
    with pytest.raises(ContractViolation, match=message):
        scoring.validate_output(damage(output), manifest)


def test_output_needs_every_manifest_zone(spark):
    scored = scoring.score_zones(ing.candidate_gaps(feature_rows(spark)))
    manifest = spark.createDataFrame([("00000000001", "r1"), ("00000000002", "r2")], "GEOID string, region string")
    out = scoring.build_output(scored, manifest)
    scoring.validate_output(out, manifest)
    assert out.filter("GEOID = '00000000002'").select("coverage_gap_score", "poi_defined").first() == (0.0, False)
    with pytest.raises(ContractViolation, match="99"):
        scoring.build_output(scored, manifest.union(spark.createDataFrame([("99", "r1")], manifest.schema)))


def test_confidence_and_provenance(spark):
    rows = [("A", 0.9), ("A", 0.8), ("A", None), ("B", None), ("B", float("nan")), ("C", 0.5)]
    got = {r[0]: (r[1], r[2]) for r in fe.confidence_features(spark.createDataFrame(rows, "z string, c double"), "z", "c").collect()}
    assert got == {"A": (pytest.approx(2 / 3), pytest.approx(0.85)), "B": (0.0, None), "C": (1.0, 0.5)}
    data = [("A", "OpenStreetMap")] * 2 + [("A", "Microsoft ML Buildings"), ("A", "USGS Lidar"), ("B", "TomTom"), ("B", "Esri")]
    p = {r["z"]: r for r in fe.source_provenance(spark.createDataFrame(data, "z string, d string"), "z", "d").collect()}
    assert (p["A"]["osm_share"], p["A"]["microsoft_share"], p["A"]["google_share"], p["A"]["other_share"]) == (0.5, 0.25, 0.0, 0.25)
    assert p["A"]["n_sources"] == 4 and p["A"]["dominant_source"] == "OpenStreetMap"
    assert p["A"]["source_entropy"] == pytest.approx(1.0397207708)
    assert p["B"]["dominant_source"] == "Esri"


def test_strata_flags_and_median_split(spark):
    rows = [("1", "r", "x", 10.0, 1.0, True), ("2", "r", None, 80.0, 2.0, True), ("3", "r", None, None, 3.0, True), ("4", "r", None, 50.0, 9.0, False)]
    df = spark.createDataFrame(rows, "GEOID string, region string, aiannh_geoid string, pct_urban double, svi_overall double, svi_covered boolean")
    got = {r["GEOID"]: tuple(r)[2:] for r in fe.strata_flags(df).collect()}
    assert got == {"1": (True, True, False), "2": (False, False, True), "3": (False, False, True), "4": (False, False, None)}


def test_stratified_pick_order_and_quota(spark):
    rows = [
        ("01", "r", False, True, True, 0.1), ("02", "r", True, True, False, 0.2), ("03", "r", False, True, False, 0.3),
        ("04", "r", False, False, True, 0.4), ("05", "r", False, False, False, 0.5), ("06", "r", False, False, False, 0.9),
        ("07", "s", False, False, False, None), ("08", "s", False, False, False, 0.2),
    ]
    df = spark.createDataFrame(rows, "GEOID string, region string, is_tribal boolean, is_rural boolean, is_water boolean, score double")
    picked = fe.stratified_pick(df, {"r": 5, "s": 2})
    got = [(r["region"], r["position"], r["GEOID"]) for r in picked.orderBy("region", "position").collect()]
    assert got == [("r", 1, "01"), ("r", 2, "02"), ("r", 3, "03"), ("r", 4, "04"), ("r", 5, "06"), ("s", 1, "07"), ("s", 2, "08")]


def test_gap_list_matches_contract(spark):
    assert len(GAPS) == 7 and all(flag.endswith("_defined") for flag, _, _ in GAPS.values())


def test_ingredients_fill_zeros_but_not_withheld_counts(spark):
    zones = spark.createDataFrame([("A", "r"), ("B", "r")], "zone_id string, region string")
    schema = lambda *c: "zone_id string, " + ", ".join(f"{x} bigint" for x in c)
    transport = spark.createDataFrame([("A", 5, 10)], schema(*RAW_COLUMNS[:2]))
    buildings = spark.createDataFrame([("A", 1, 1, 2, 2)], schema(*RAW_COLUMNS[2:6]))
    places = spark.createDataFrame([("A", 1, 1, 1, 1, 1, 1, 4)], schema(*RAW_COLUMNS[6:]))
    est = spark.createDataFrame([("A", 8), ("B", None)], schema("cbp_estab_bus"))
    rows = {r["zone_id"]: r for r in ing.zone_ingredients(zones, transport, buildings, places, est).collect()}
    assert rows["A"]["transport_gap"] == 0.5 and rows["A"]["poi_gap_establishments"] == 0.5
    assert rows["B"]["overture_places_count"] == 0 and rows["B"]["cbp_estab_bus"] is None
    assert rows["B"]["transport_gap"] is None and rows["B"]["transport_defined"] is False
