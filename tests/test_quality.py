"""Contracts, profiles, order statistics, sets and the column catalogue."""

import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from coverlay.functions import values as v
from coverlay.operators import catalog, contracts, ordering, profile, sets
from coverlay.operators.spread import spread
from coverlay.plans import scoring, strata_rules
from coverlay.sources.contracts import (
    ESTABLISHMENTS,
    LAYER_CONTRACTS,
    OBSERVED_BUILDINGS,
    OBSERVED_PLACES,
    OBSERVED_ROADS,
    REFERENCE_BUILDINGS,
    REFERENCE_ROADS,
)

ROADS = "LINEARID string, FULLNAME string, RTTYP string, MTFCC string, geometry binary"
BUILDINGS = "height double, confidence double, geometry binary"
CBP = "GEOID {key}, STATEFP string, COUNTYFP string, TRACTCE string, cbp_estab bigint, cbp_estab_res bigint, cbp_estab_bus bigint, geometry binary"


def problems(df, contract):
    with pytest.raises(contracts.ContractViolation) as caught:
        contracts.enforce(df, contract)
    return str(caught.value)


def test_valid_rows_pass(spark):
    contracts.enforce(spark.createDataFrame([(None, None, None, None)], "subtype string, class string, sources array<int>, geometry binary"), OBSERVED_BUILDINGS)
    contracts.enforce(spark.createDataFrame([(1.0, -1.0, None), (None, 0.5, None), (2.0, None, None)], BUILDINGS), REFERENCE_BUILDINGS)
    contracts.enforce(spark.createDataFrame([("1", None, None, "S1100", None)], ROADS), REFERENCE_ROADS)
    contracts.enforce(spark.createDataFrame([("04013000100", "04", "013", "000100", 1, 0, None, None)], CBP.format(key="string")), ESTABLISHMENTS)


def test_placeholder_is_allowed_for_one_layer_only(spark):
    assert "in [0, 1] or -1.0" in problems(spark.createDataFrame([(1.0, -0.5, None)], BUILDINGS), REFERENCE_BUILDINGS)
    places = "categories struct<primary:string>, confidence double, geometry binary"
    assert "confidence" in problems(spark.createDataFrame([(None, -1.0, None)], places), OBSERVED_PLACES)


def test_all_violations_are_reported_together(spark):
    df = spark.createDataFrame([(None, "a", "b", "S11", None)] * 30, ROADS)
    text = problems(df, REFERENCE_ROADS)
    assert "LINEARID" in text and "MTFCC" in text and text.count("S11") == contracts.MAX_EXAMPLES
    missing = problems(spark.createDataFrame([(1,)], "x int"), OBSERVED_ROADS)
    assert all(name in missing for name in ("subtype", "class", "geometry"))


def test_strict_layers_refuse_extra_columns(spark):
    extra = spark.createDataFrame([(1.0, 0.5, None, 1)], BUILDINGS + ", extra int")
    assert "extra: unexpected column" in problems(extra, REFERENCE_BUILDINGS)
    roads = spark.createDataFrame([("road", None, None, 1)], "subtype string, class string, geometry binary, extra int")
    contracts.enforce(roads, OBSERVED_ROADS)
    assert "subtype" in problems(spark.createDataFrame([(None, "x", None)], "subtype string, class string, geometry binary"), OBSERVED_ROADS)


def test_integer_and_malformed_keys_are_refused(spark):
    row = (4013000100, "04", "013", "000100", 1, 0, 1, None)
    assert "GEOID: type bigint" in problems(spark.createDataFrame([row], CBP.format(key="bigint")), ESTABLISHMENTS)
    bad = spark.createDataFrame([("4013000100", "0x", "013", "000100", -1, 0, 1, None)], CBP.format(key="string"))
    text = problems(bad, ESTABLISHMENTS)
    assert "11 digits" in text and "2 digits" in text and ">= 0" in text
    with pytest.raises(contracts.ContractViolation):
        contracts.require_text_key(spark.createDataFrame([(1,)], "GEOID int"), "GEOID")
    contracts.require_text_key(spark.createDataFrame([(None,)], "GEOID string"), "GEOID")
    contracts.require_text_key(spark.createDataFrame([(1,)], "other int"), "GEOID")


def test_registry_covers_the_known_layers():
    assert len(LAYER_CONTRACTS) == 11 and "census-acs-housing" not in LAYER_CONTRACTS


def test_one_to_one_and_completeness(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("a", 11)], "k string, y int")
    with pytest.raises(PySparkException, match="repeated on the right"):
        contracts.one_to_one(left, right, "k").collect()
    joined = contracts.one_to_one(left, right.filter("y = 10"), "k")
    assert sorted(tuple(r) for r in joined.collect()) == [("a", 1, 10), ("b", 2, None)]
    with pytest.raises(contracts.ContractViolation, match="y"):
        contracts.require_complete(joined, ["x", "y"], "k")


def test_expectations(spark):
    got = spark.createDataFrame([("a", 5), ("b", 7)], "k string, n int")
    want = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "k string, expected int")
    rows = {r["k"]: r["passed"] for r in contracts.against_expected(got, want, "k", "n", tolerance=1).collect()}
    assert rows == {"a": True, "b": False, "c": False}


# --- profiles ------------------------------------------------------------------------------


def test_null_profile_fixture(spark):
    rows = [("1", True, 10.0, "x"), ("2", False, None, "y"), ("3", None, 20.0, None), ("4", True, float("nan"), "x")]
    df = spark.createDataFrame(rows, "GEOID string, some_flag boolean, some_measure double, some_text string")
    found = profile.null_profile(df, ["some_flag", "some_measure", "some_text"], F.lit(None).cast("string"))
    p = {r["column_name"]: r for r in found.collect()}
    m = p["some_measure"]
    assert (m["n_null"], m["pct_null"], m["min"], m["max"], m["mean"], m["n_distinct"]) == (2, 0.5, 10.0, 20.0, 15.0, 2)
    assert (p["some_text"]["n_null"], p["some_text"]["n_distinct"], p["some_text"]["min"]) == (1, 2, None)
    assert p["some_flag"]["mean"] is None


def test_sentinels(spark):
    rows = [(i, -1.0 if i < 3 else 5.0 * i, -1.0 if i == 0 else 5.0) for i in range(5)]
    few = spark.createDataFrame([(i, 5.0 if i else -1.0) for i in range(200)], "i int, rare double")
    df = spark.createDataFrame(rows, "i int, often double, once double")
    note = {r["column_name"]: r["sentinel_note"] for r in profile.null_profile(df, ["often"], F.lit("r")).filter("scope = 'r'").collect()}
    assert note["often"] == "possible coded-missing sentinel(s): -1.0 in 60.0% of non-null rows"
    assert profile.null_profile(few, ["rare"], F.lit("r")).first()["sentinel_note"] is None


def test_flag_groups_by_table_and_prefix(spark):
    rows = [("one", c) for c in ("a_covered", "a_x", "other")] + [("two", c) for c in ("b_covered", "b_1", "c_covered", "c_1", "window")]
    groups = profile.flag_groups(spark.createDataFrame(rows, "source_table string, column_name string"))
    got = {}
    for r in groups.filter("member_column is not null").collect():
        got.setdefault(r["flag_column"], set()).add(r["member_column"])
    assert got == {"a_covered": {"a_x", "other"}, "b_covered": {"b_1"}, "c_covered": {"c_1"}}


def test_flag_consistency_ignores_null_flags(spark):
    rows = [(True, 1.0, None), (True, None, None), (False, None, None), (False, None, 2.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "f boolean, a double, b double")
    found = {r["scope"]: tuple(r)[2:] for r in profile.flag_consistency(df, {"f": ["a", "b"]}, F.lit("r")).collect()}
    assert found == {"r": (2, 2, 2, 1, 1), "national": (2, 2, 2, 1, 1)}
    empty = profile.flag_consistency(df, {"f": []}, F.lit("r")).first()
    assert tuple(empty)[2:] == (0, 0, 0, 0, 0)


def test_top_values_text(spark):
    df = spark.createDataFrame([(str(i % 20), None) for i in range(100)] + [("3", None)], "a string, b string")
    rows = {r["column_name"]: r["values"] for r in profile.top_values(df, ["a", "b"], k=2).collect()}
    assert rows == {"a": "3 (6); 0 (5); ... +18 more distinct value(s)", "b": "(all null)"}


def test_duplicates_weighted_mean_and_mix(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert profile.duplicate_keys(df, "k").first()[0] == 2
    w = spark.createDataFrame([("r", 0.5, 10.0), ("r", 1.0, 30.0), ("r", None, 9.0), ("r", 0.1, 0.0), ("s", None, 1.0)], "g string, v double, w double")
    got = {r["g"]: (r["weighted_mean"], r["n_used"]) for r in profile.weighted_mean(w, "v", "w", ["g"]).collect()}
    assert got == {"r": (0.875, 2), "s": (None, 0)}
    lists = spark.createDataFrame([(1, [("x", 0.5), ("y", None)]), (1, []), (1, None)], "p int, s array<struct<dataset:string,confidence:double>>")
    mix = {r["dataset"]: (r["n"], r["confident_pct"], r["max_elements"], r["empty_lists"]) for r in profile.source_mix(lists, "s", ["p"]).collect()}
    assert mix == {"x": (1, 100.0, 2, 2), "y": (1, 0.0, 2, 2)}


def test_near_misses(spark):
    real = spark.createDataFrame([("Motorway",), ("motorway",), ("motorway_link",), ("way",), (None,), ("road",)], "c string")
    got = sorted(tuple(r) for r in profile.near_misses(real, "c", ["motorway"]).collect())
    assert got == [("motorway", "Motorway"), ("motorway", "motorway_link"), ("motorway", "way")]


# --- order statistics ----------------------------------------------------------------------


def test_quantiles_and_ranks_match_plain_python(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, float(rng.randint(0, 20)), rng.uniform(0, 20)])) for g in "ab" for _ in range(500)]
    rows += [("hot", 7.0)] * 400 + [("solo", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("i", F.monotonically_increasing_id())
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in ordering.exact_quantiles(df, "v", {"lo": 0.02, "mid": 0.5, "hi": 0.98}, ["g"]).collect()}
    for g in ("a", "b", "hot", "solo"):
        data = sorted(v for k, v in rows if k == g and v is not None)

        def at(p):
            h = p * (len(data) - 1)
            lo = int(h)
            hi = min(lo + 1, len(data) - 1)
            return data[lo] + (data[hi] - data[lo]) * (h - lo)

        assert got[g] == (pytest.approx(at(0.02)), pytest.approx(statistics.median(data)), pytest.approx(at(0.98)))
    ranked = {r["i"]: (r["v"], r["rank"]) for r in ordering.average_ranks(df.filter("g = 'a'"), {"v": "rank"}).collect()}
    values = [v for v, _ in ranked.values() if v is not None]
    for v, rank in ranked.values():
        want = None if v is None else sum(x < v for x in values) + (values.count(v) + 1) / 2
        assert rank == want


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("r", float(x)) for x in (0, 1, 2, 3, 4)] + [("s", 5.0), ("s", None)], "g string, v double")
    got = sorted(tuple(r) for r in ordering.histogram(df, "v", "g", bins=4).collect())
    assert got == [("r", 0, 1), ("r", 1, 1), ("r", 2, 1), ("r", 3, 2), ("s", 0, 1)]


def test_words_are_no_patterns(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("Café (x)",), (None,)], "t string")
    got = [r[0] for r in df.select(v.matches_any_word("t", ["a.b", "(X)"])).collect()]
    assert got == [True, False, True, False]


def test_more_groups_than_any_lookup_would_hold(spark):
    df = spark.range(40_000).select((F.col("id") % 20_000).cast("string").alias("g"), F.col("id").cast("double").alias("v"), F.lit(True).alias("c"))
    assert ordering.histogram(df, "v", "g", bins=2).agg(F.sum("n")).first()[0] == 40_000
    split = ordering.median_split(df, "v", "c", "g", "high")
    assert split.columns == ["g", "v", "c", "high"] and split.filter("high").count() == 20_000


def test_one_value_on_a_third_of_the_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = sorted(5.0 if i % 3 == 0 else float(i) for i in range(3000))
    row = ordering.exact_quantiles(df, "v", {"low": 0.2, "mid": 0.5}).first()
    assert row["low"] == 5.0
    at = 0.5 * 2999
    assert row["mid"] == pytest.approx(values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at % 1))


def test_tables_are_dealt_out_where_the_session_asks(spark):
    df = spark.range(10).coalesce(1)
    assert spread(df) is df
    spark.conf.set("spark.coverlay.scanPartitions", "3")
    try:
        assert spread(df).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.coverlay.scanPartitions")


# --- sets ----------------------------------------------------------------------------------


def test_reconcile(spark):
    package = spark.range(1, 6011).select(F.lit("r").alias("region"), F.format_string("%04d", "id").alias("k"))
    scored = package.filter("k <= '6003'").union(spark.createDataFrame([("q", "x")], package.schema))
    rows = {r["region"]: r for r in sets.reconcile(package, scored, "k", "region").collect()}
    assert (rows["r"]["extra_count"], rows["r"]["missing_count"]) == (7, 0)
    assert rows["r"]["extra_sample"] == "6004;6005;6006;6007;6008;6009;6010"
    assert (rows["q"]["missing_count"], rows["q"]["missing_sample"]) == (1, "x")


def test_shared_and_differing_sets(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "a")], "k string, g string")
    assert [tuple(r) for r in sets.shared_across(df, "k", "g").collect()] == [("1", 2, "a;b")]
    wide = spark.createDataFrame([("r", "x"), ("r", "y"), ("s", "x")], "g string, c string")
    got = {r["g"]: tuple(r)[1:] for r in sets.value_set_difference(wide, wide.filter("c = 'x'"), "c", "g").collect()}
    assert got == {"r": ("y", "", False), "s": ("", "", True)}
    assert sets.missing_keys(wide, wide.filter("c = 'x'"), ["g", "c"]).count() == 1


# --- catalogue -----------------------------------------------------------------------------


def test_roles_from_the_fixed_rules(spark):
    names = ["GEOID", "ALAND", "pop_total", "uhe_city_name", "epht_metric", "svi_covered", "fod_ever", "svi_overall"]
    columns = spark.createDataFrame([(n,) for n in names], "column_name string")
    got = {r[0]: r[1] for r in catalog.classify_first_match(columns, strata_rules.role_rules(spark), strata_rules.DEFAULT_ROLE).collect()}
    assert [got[n] for n in names] == [
        "identifier", "geometry_measure", "population", "identity_metadata", "vintage_metadata", "coverage_flag", "derived_ever_flag", "measurement",
    ]


def test_constant_columns_are_never_usable_and_tags_follow_rules(spark):
    rows = [
        ("svi_overall", "svi", "measurement", 900), ("rucc_covered", "rurality", "coverage_flag", 1), ("GEOID", "geography", "identifier", 900),
        ("cvi_climate", "cvi", "measurement", 50), ("rucc_2023", "rurality", "measurement", 9), ("aiannh_name", "tribal", "identity_metadata", 40),
        ("tribal_pct", "tribal", "measurement", 99),
    ]
    columns = spark.createDataFrame(rows, "column_name string, domain string, role string, n_distinct int")
    usable = catalog.usability(columns, strata_rules.NOT_USABLE, strata_rules.USABLE_REASONS, strata_rules.DEFAULT_REASON)
    allowed = {r["column_name"]: r["allowed_for_bias"] for r in usable.collect()}
    assert not allowed["rucc_covered"] and not allowed["GEOID"] and allowed["svi_overall"]
    tagged = {r["column_name"]: r["candidate_hypotheses"] for r in catalog.tag_columns(usable, strata_rules.tag_rules(spark)).collect()}
    generic = "Measurement Eligibility Bias; Source Provenance x Vulnerability; Component Dominance"
    assert tagged["svi_overall"] == generic and tagged["rucc_covered"] == tagged["GEOID"] == ""
    assert tagged["cvi_climate"] == generic + "; CVI Pillar Decomposition"
    assert tagged["rucc_2023"] == generic + "; Dispatch-Blind Reachability; RUCA/RUCC/NCHS Disagreement"
    assert tagged["aiannh_name"] == "Tribal Sub-type + Edge Effect; Population Exposure vs. Disparity"
    assert tagged["tribal_pct"].count(";") == 5


def test_attribution_outcomes(spark):
    sources = spark.createDataFrame([("national-svi-tract-table", "svi_overall"), ("t1", "dup"), ("t2", "dup"), ("t1", "ALAND"), (strata_rules.BACKBONE_TABLE, "pop_total")], "source_table string, column_name string")
    joined = spark.createDataFrame([(c, "double", i) for i, c in enumerate(["svi_overall", "dup", "ALAND", "none", "pop_total"])], "column_name string, dtype string, position int")
    found = catalog.attribute_columns(joined, sources, strata_rules.BACKBONE_COLUMNS, strata_rules.BACKBONE_TABLE, strata_rules.table_domains(spark), strata_rules.column_domains(spark))
    got = {r["column_name"]: (r["source_table"], r["attribution_method"], r["domain"]) for r in found.collect()}
    assert got == {
        "svi_overall": ("national-svi-tract-table", "unambiguous", "svi"),
        "dup": ("t1|t2", "AMBIGUOUS", "UNCLASSIFIED"),
        "ALAND": (strata_rules.BACKBONE_TABLE, "shared-backbone", "geography"),
        "none": ("<none>", "NOT_FOUND", "UNCLASSIFIED"),
        "pop_total": (strata_rules.BACKBONE_TABLE, "unambiguous", "population"),
    }
    assert {r["column_name"] for r in catalog.unresolved(found, strata_rules.VALID_DOMAINS).collect()} == {"dup", "none"}


def test_schema_comparison_and_risks(spark):
    kind = "source_table string, column_name string, position int, dtype string"
    a = spark.createDataFrame([("n", "x", 0, "int"), ("n", "y", 1, "int"), ("n", "z", 2, "int")], kind)
    b = spark.createDataFrame([("r", "y", 0, "int"), ("r", "x", 1, "int"), ("r", "w", 2, "int")], kind)
    verdict = catalog.schema_verdict(a, b).first()
    assert tuple(verdict) == (1, 1, 0, 0, 0, False, False)
    same = catalog.schema_verdict(a, a).first()
    assert same["columns_match"] and same["order_matches"]
    twice = spark.createDataFrame([("n", "x", 0, "int"), ("n", "d", 1, "int"), ("n", "d", 2, "int"), ("n", "y", 3, "int")], kind)
    # A name twice on both sides is counted on each and spoils no other check.
    assert tuple(catalog.schema_verdict(twice, twice).first()) == (0, 0, 0, 1, 1, True, False)
    rows = [("ok", "GEOID", 0, "string"), ("int", "GEOID", 0, "bigint"), ("alias", "county_fips", 0, "string"), ("none", "x", 0, "string"), ("twice", "GEOID", 0, "int"), ("twice", "GEOID", 1, "int")]
    risks = {r["source_table"]: (r["finding"], r["detail"]) for r in catalog.schema_risks(spark.createDataFrame(rows, kind)).collect()}
    assert risks == {
        "int": ("unsafe_key_dtype", "bigint"), "alias": ("missing_key", "county_fips"), "none": ("missing_key", ""), "twice": ("duplicate_column_names", "GEOID"),
    }


def test_region_presence_counts_absent_rows_as_missing(spark):
    rows = [("a", "r1", True), ("a", "r2", True), ("b", "r1", True), ("c", "r1", False)]
    got = {r[0]: tuple(r)[1:] for r in catalog.region_presence(spark.createDataFrame(rows, "column_name string, region string, in_region boolean"), ["r1", "r2"]).collect()}
    assert got == {"a": ("r1;r2", "", True), "b": ("r1", "r2", False), "c": ("", "r1;r2", False)}


def test_reclassification(spark):
    crosswalk = spark.createDataFrame([("04013", 2, 2), ("48029", 3, 4), ("40001", 6, 6)], "county_fips string, o int, n int")
    keys = spark.createDataFrame([("04013",), ("48029",), ("99999",)], "county_fips string")
    got = {r[0]: (r["found"], r["reclassified"]) for r in catalog.reclassified(keys, crosswalk, "county_fips", "o", "n").collect()}
    assert got == {"04013": (True, False), "48029": (True, True), "99999": (False, None)}


def test_value_helpers(spark):
    df = spark.createDataFrame([(4.0, 13.0, "04013000100", "a; b", " X ")], "s double, c double, z string, t string, w string")
    row = df.select(v.county_key("s", "c"), v.county_of("z"), v.parse_tags("t"), v.has_tag("t", "b"), v.has_tag("t", "a; b"), v.normalise("w"), v.label_of(F.lit(3), v.URBAN_RURAL_LABELS), v.label_of(F.lit(9), v.URBAN_RURAL_LABELS), v.strip_suffix(F.lit("x_covered"), "_covered")).first()
    assert tuple(row) == ("04013", "04013", ["a", "b"], True, False, "x", "Medium metro", None, "x")
    assert df.select(v.parse_tags(F.lit(None).cast("string")), v.parse_tags(F.lit(""))).first() == ([], [])
    with pytest.raises(PySparkException, match="shorter than 5"):
        df.select(v.county_of(F.lit("0401"))).collect()


def test_over_count_and_band(spark):
    a = spark.createDataFrame([("x",)] * 8 + [("y",)], "g string")
    b = spark.createDataFrame([("x",)] * 2, "g string")
    got = {r["g"]: (r["ratio"], r["over_counted"]) for r in scoring.over_count(a, b, "g").collect()}
    assert got == {"x": (4.0, True), "y": (None, False)}
    totals = spark.createDataFrame([("r", 8.0, 10.0), ("s", 1.0, 10.0), ("t", 1.0, 0.0)], "region string, o double, k double")
    assert {r["region"]: r["in_band"] for r in scoring.ratio_band(totals, "o", "k").collect()} == {"r": True, "s": False, "t": False}
