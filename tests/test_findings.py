"""Findings that survive failing layers, violations with examples, nested schemas, samples."""

import pytest
from pyspark.sql import functions as F

from coverlay.functions import shapes
from coverlay.operators import catalog, contracts
from coverlay.plans import audit
from coverlay.sources import geo

CONTRACT = contracts.Contract("plots", (contracts.digits("GEOID", 3), contracts.share("part"), contracts.present("geometry")))


def plots(spark, rows):
    df = spark.createDataFrame(rows, "region string, GEOID string, part double, x double")
    point = geo.encode_wkb(F.when(F.col("x").isNotNull(), shapes.point_geom("x", "x")))
    return df.select("region", "GEOID", "part", point.alias("geometry"))


def raising(problem):
    def load():
        raise problem

    return load


def test_each_failure_costs_its_own_layer_only(spark):
    sound = plots(spark, [("a", "001", 0.5, 1.0), ("a", "001", None, None), ("b", "002", 0.1, 1.0), ("b", "003", 2.0, 1.0)])
    broken = sound.withColumn("geometry", F.lit(b"\x01\x09").cast("binary"))
    loaders = {
        "good": lambda: sound,
        "value": raising(ValueError("no such plane")),
        "read": raising(RuntimeError("connection lost")),
        "odd": raising(KeyError("x")),
        "absent": raising(FileNotFoundError("gone")),
        "unknown": lambda: sound,
        "typed": lambda: sound.withColumn("GEOID", F.lit(1)),
        "undecodable": lambda: broken.filter("part <= 1"),
        "empty": lambda: sound.limit(0),
    }
    known = dict.fromkeys(set(loaders) - {"unknown"}, CONTRACT)
    expected = {"good": spark.createDataFrame([("a", 3), ("b", 2)], "region string, expected_row_count long")}
    found = audit.audit_regions(spark, loaders, known, ["a", "b", "c"], expected=expected)
    rows = {(r["layer"], r["region"]): r for r in found.collect()}
    assert len(rows) == 27
    status = {layer: [rows[layer, r]["status"] for r in "abc"] for layer in loaders}
    assert status["good"] == ["ok", "schema_violation", "missing_file"]
    assert status["empty"] == ["missing_file"] * 3
    for layer, name in {"value": "value_error", "read": "read_error", "odd": "error", "absent": "missing_file", "unknown": "not_implemented", "typed": "schema_violation"}.items():
        assert status[layer] == [name] * 3
    assert "expected string" in rows["typed", "a"]["error_message"] and rows["value", "b"]["error_message"] == "no such plane"
    assert rows["good", "b"]["error_message"] == "part: 1 rows fail 'in [0, 1]', e.g. 2.0"
    good = rows["good", "a"]
    assert (good["row_count"], good["null_geometry_count"], good["duplicate_count"], good["row_count_matches_expected"]) == (2, 1, 1, False)
    assert good["null_pct_by_column"] == '{"GEOID":0.0,"part":0.5,"geometry":0.5}'
    assert rows["good", "b"]["row_count"] is None
    assert status["undecodable"][0] == "audit_error" and rows["undecodable", "a"]["error_message"]


def test_violations_by_region_and_in_one_job(spark):
    rows = [("a", "1", 0.5, None)] * 15 + [("a", None, 3.0, None), ("b", "001", -1.0, None), (None, "22", 0.0, None)]
    df = plots(spark, rows)
    got = {(r["region"], r["column_name"], r["check_name"]): (r["violations"], r["examples"]) for r in contracts.violations(df, CONTRACT, ["region"], 3).collect()}
    assert got == {
        ("a", "GEOID", "3 digits"): (15, ["1"] * 3),
        ("a", "GEOID", "not null"): (1, []),
        ("a", "part", "in [0, 1]"): (1, ["3.0"]),
        ("b", "part", "in [0, 1]"): (1, ["-1.0"]),
        (None, "GEOID", "3 digits"): (1, ["22"]),
    }
    every = contracts.violations(df.limit(0), CONTRACT).collect()
    assert len(every) == 3 and not any(r["violations"] or r["examples"] for r in every)
    assert contracts.violations(df, contracts.Contract("none", ())).count() == 0


def test_nested_fields_are_listed(spark):
    nested = "id long, sources array<struct<dataset:string, at:struct<x:double>>>, tags map<string,array<int>>"
    rows = catalog.nested_rows(spark, {"t": spark.createDataFrame([], nested)}).orderBy("position").collect()
    assert [(r["column_name"], r["dtype"]) for r in rows] == [
        ("id", "bigint"), ("sources[].dataset", "string"), ("sources[].at.x", "double"), ("tags{key}", "string"), ("tags{value}[]", "int"),
    ]
    other = catalog.nested_rows(spark, {"o": spark.createDataFrame([], nested.replace("x:double", "x:float"))})
    verdict = catalog.schema_verdict(catalog.nested_rows(spark, {"t": spark.createDataFrame([], nested)}), other).first()
    assert verdict["dtype_mismatches"] == 1 and not verdict["columns_match"]


def test_sample_reads_leading_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100_000, 1, 1).write.option("parquet.block.size", 64 * 1024).parquet(path)
    spark.range(0, 0).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 * 1024)
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() > 3
        sample = geo.first_rows(spark, path, ["id"], 50)
        assert [r["id"] for r in sample.collect()] == list(range(50))
        assert sample.rdd.getNumPartitions() == 1
        seen = spark.sparkContext.accumulator(0)
        geo.first_rows(spark, path, ["id"], 50).foreach(lambda _: seen.add(1))
        assert seen.value == 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    empty = str(tmp_path / "e")
    spark.range(0).write.parquet(empty)
    assert geo.first_rows(spark, empty, ["id"], 5).count() == 0
    with pytest.raises(FileNotFoundError):
        geo.first_rows(spark, str(tmp_path / "none"), ["id"])
