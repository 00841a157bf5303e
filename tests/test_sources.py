"""Loaders and sinks on files written to a temporary folder."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from coverlay.operators.contracts import ContractViolation
from coverlay.sources import geo, tables
from tests.geometry import box, line, point, shapes_frame


@pytest.fixture
def places(spark, tmp_path):
    path = str(tmp_path / "places.parquet")
    rows = {"a": point(-112.0, 33.0), "b": point(-111.0, 34.0)}
    stored = shapes_frame(spark, rows).select(
        F.struct(F.lit("fire_department").alias("primary")).alias("categories"),
        F.lit(0.5).alias("confidence"),
        geo.encode_wkb("geom").alias("geometry"),
    )
    stored.write.parquet(path)
    return path


def test_load_layer_decodes_checks_and_guards(spark, places):
    df = geo.load_layer(spark, places, "observed-places")
    assert set(df.columns) == {"categories", "confidence", "geom", "xmin", "ymin", "xmax", "ymax"}
    assert df.agg(F.min("xmin"), F.max("ymax")).first() == (-112.0, 34.0)
    with pytest.raises(NotImplementedError, match="rail"):
        geo.load_layer(spark, places, "rail")
    with pytest.raises(ContractViolation):
        geo.load_layer(spark, places, "observed-roads")
    with pytest.raises(FileNotFoundError, match="nowhere"):
        geo.load_layer(spark, places + "/nowhere", "observed-places")


def test_projected_coordinates_are_refused(spark):
    metres = geo.with_bounds(shapes_frame(spark, {"m": box(500000, 4000000, 500010, 4000010)}))
    with pytest.raises(ContractViolation, match="lon/lat"):
        geo.require_lonlat(metres)
    swapped = geo.coordinate_report(geo.with_bounds(shapes_frame(spark, {"s": point(33.0, -112.0), "n": None}))).first()
    assert tuple(swapped) == (1, 1, 1)


def test_guard_fails_the_query_that_reads_a_bad_row(spark):
    frame = shapes_frame(spark, {"m": box(500000, 4000000, 500010, 4000010), "ok": box(1, 1, 2, 2)})
    raw = frame.select("fid", F.lit("s").alias("subtype"), F.lit("c").alias("class"), geo.encode_wkb("geom").alias("geometry"))
    assert geo.checked_layer(raw.filter("fid = 'ok'"), "observed-roads").agg(F.max("xmax")).first()[0] == 2.0
    with pytest.raises(PySparkException, match="lon/lat"):
        geo.checked_layer(raw, "observed-roads").agg(F.max("xmin")).collect()


def test_geographic_strata_keep_their_key(spark, tmp_path):
    path = str(tmp_path / "strata")
    shapes_frame(spark, {"04013000100": box(1, 1, 2, 2)}).select(F.col("fid").alias("GEOID"), geo.encode_wkb("geom").alias("geometry")).write.parquet(path)
    assert geo.load_strata_geo(spark, path).select("GEOID", "xmax").first() == ("04013000100", 2.0)


def test_kind_guard(spark):
    frame = shapes_frame(spark, {"a": point(1, 1), "b": line((0, 0), (1, 1)), "c": None})
    with pytest.raises(ContractViolation, match="LINE"):
        geo.require_kind(frame, ("POINT",))
    assert geo.require_kind(frame, ("POINT", "LINE")).count() == 3


def test_any_and_projected_scans(spark, places, tmp_path):
    assert "geom" in geo.read_any(spark, places).columns
    flat = str(tmp_path / "flat")
    spark.createDataFrame([("04013000100", 1)], "GEOID string, n int").write.parquet(flat)
    assert geo.read_any(spark, flat).columns == ["GEOID", "n"]
    with pytest.raises(ContractViolation):
        geo.read_geo(spark, flat)
    assert geo.read_columns(spark, places, ["confidence", "absent"]).columns == ["confidence"]
    with pytest.raises(ContractViolation):
        geo.read_columns(spark, places, ["absent"])
    assert geo.load_strata_flat(spark, flat).count() == 1
    number = str(tmp_path / "number")
    spark.createDataFrame([(4013000100, 1)], "GEOID bigint, n int").write.parquet(number)
    with pytest.raises(ContractViolation, match="GEOID"):
        geo.load_strata_flat(spark, number)


def test_window_read_prunes_on_the_stored_box(spark, tmp_path):
    path = str(tmp_path / "boxed")
    rows = spark.range(1000).select("id", F.struct(F.col("id").cast("double").alias("xmin"), F.lit(0.0).alias("ymin"), (F.col("id") + 1.0).alias("xmax"), F.lit(1.0).alias("ymax")).alias("bbox"))
    rows.write.parquet(path)
    hits = geo.read_window(spark, path, 10.5, 0.0, 12.5, 1.0)
    assert sorted(r["id"] for r in hits.collect()) == [10, 11, 12]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(bbox.xmin)" in plan


def test_regions_partition_and_row_counts(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.range(100).select(F.format_string("%011d", "id").alias("GEOID"), F.when(F.col("id") < 90, "big").otherwise("small").alias("region"))
    tables.write_regions(df, path)
    assert geo.read_regions(spark, path).count() == 100
    small = geo.read_regions(spark, path, ["small"])
    assert small.count() == 10 and "PartitionFilters: [isnotnull(region" in small._jdf.queryExecution().executedPlan().toString()
    assert geo.count_by_file(geo.read_regions(spark, path)).agg(F.sum("n_rows")).first()[0] == 100
    tables.write_regions(df, str(tmp_path / "many"), rows_per_file=10)
    files = geo.count_by_file(geo.read_regions(spark, str(tmp_path / "many"))).groupBy(F.col("file").contains("region=big").alias("big")).count().collect()
    assert {r["big"]: r["count"] for r in files}[False] == 1 and {r["big"]: r["count"] for r in files}[True] > 3


def test_manifest_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("GEOID,region,transport_gap\n04013000100,r,0.5\n40001000100,r,\n")
    m = tables.load_manifest(spark, str(path))
    assert [tuple(r) for r in m.orderBy("GEOID").collect()] == [("04013000100", "r", 0.5), ("40001000100", "r", None)]
    bad = tmp_path / "bad.csv"
    bad.write_text("GEOID,x\n1,2\n")
    with pytest.raises(ContractViolation, match="region"):
        tables.load_manifest(spark, str(bad))


def test_crosswalk_and_csv_sink(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("STFIPS,CTYFIPS,CODE2013,CODE2023\n4,13,2,2\n48.0,29,3,4\n")
    rows = sorted((r["county_fips"], r["CODE2013"], r["CODE2023"]) for r in tables.load_crosswalk(spark, str(path)).collect())
    assert rows == [("04013", 2, 2), ("48029", 3, 4)]
    with pytest.raises(ContractViolation, match="CODE2023"):
        short = tmp_path / "short.csv"
        short.write_text("STFIPS,CTYFIPS,CODE2013\n4,13,2\n")
        tables.load_crosswalk(spark, str(short))
    out = str(tmp_path / "out")
    tables.write_csv(spark.createDataFrame([("04", 1)], "GEOID string, n int"), out, single_file=True)
    assert tables.read_csv_text(spark, out).first()["GEOID"] == "04"
