"""Measures, projection, validity and WKB on small geometries."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from coverlay.functions import geodesy, kernels, shapes
from coverlay.plans import audit
from coverlay.sources import geo
from tests.geometry import ZONE_SCHEMA, box, line, multiline, multipolygon, point, polygon, shapes_frame

LON, LAT = -112.0740, 33.4484
GOLDEN = (-1477242.845010892, 1278582.822713835)


def one(spark, geom, column):
    return shapes_frame(spark, {"g": geom}).select(column).first()[0]


def test_projection_hits_golden_point_and_inverts(spark):
    x, y = geodesy.equal_area_xy(F.lit(LON), F.lit(LAT))
    lon, lat = geodesy.lonlat_of(x, y)
    row = spark.range(1).select(x, y, lon, lat).first()
    assert row[0] == pytest.approx(GOLDEN[0], abs=1e-6) and row[1] == pytest.approx(GOLDEN[1], abs=1e-6)
    assert row[2] == pytest.approx(LON, abs=1e-12) and row[3] == pytest.approx(LAT, abs=1e-12)


def test_inverse_is_exact_over_the_country():
    lon, lat = np.meshgrid(np.linspace(-125, -66, 30), np.linspace(24, 50, 30))
    back = geodesy.unproject(np, *geodesy.project(np, lon, lat))
    assert np.abs(back[0] - lon).max() < 1e-11 and np.abs(back[1] - lat).max() < 1e-11


def test_area_and_length_in_expected_range(spark):
    square = box(LON, LAT, LON + 0.01, LAT + 0.01)
    assert 0.5e6 < one(spark, square, shapes.area_m2("geom")) < 2e6
    assert 700 < one(spark, line((LON, LAT), (LON + 0.01, LAT)), shapes.length_m("geom")) < 1100


@pytest.mark.parametrize(
    "geom,measure",
    [(line((0, 30), (1, 31)), shapes.area_m2), (box(0, 30, 1, 31), shapes.length_m), (point(0, 30), shapes.area_m2)],
)
def test_wrong_kind_is_an_error(spark, geom, measure):
    with pytest.raises(PySparkException):
        one(spark, geom, measure("geom"))


def test_null_geometry_stays_null(spark):
    row = shapes_frame(spark, {"n": None, "b": box(0, 30, 1, 31)}).orderBy("fid").select(shapes.area_m2("geom"), shapes.is_empty("geom")).collect()
    assert row[0][0] > 0 and row[0][1] is False
    assert row[1][0] is None and row[1][1] is None


def test_holes_and_parts_in_measures(spark):
    frame = shapes_frame(
        spark,
        {
            "hole": polygon([(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (4, 2), (4, 4), (2, 4)]),
            "reversed": polygon([(0, 0), (0, 10), (10, 10), (10, 0)], [(2, 2), (4, 2), (4, 4), (2, 4)]),
            "parts": multipolygon([[(0, 0), (2, 0), (2, 2), (0, 2)]], [[(10, 0), (12, 0), (12, 2), (10, 2)]]),
            "lines": multiline([(0, 0), (3, 4)], [(0, 0), (0, 5)]),
            "point": point(3, 4),
            "sliver": polygon([(0, 0), (4, 0), (2, 0)]),
        },
    )
    m = {r["fid"]: r["m"] for r in frame.select("fid", shapes.measures("geom").alias("m")).collect()}
    assert m["hole"]["area"] == m["reversed"]["area"] == 96.0
    assert m["hole"]["length"] == 48.0 and m["hole"]["n_points"] == 10
    assert m["hole"]["cx"] == pytest.approx((100 * 5 - 4 * 3) / 96)
    assert (m["parts"]["cx"], m["parts"]["cy"], m["parts"]["area"]) == (6.0, 1.0, 8.0)
    assert (m["parts"]["xmin"], m["parts"]["xmax"]) == (0.0, 12.0)
    assert m["lines"]["length"] == 10.0
    assert (m["point"]["cx"], m["point"]["cy"]) == (3.0, 4.0)
    assert (m["sliver"]["area"], m["sliver"]["cx"], m["sliver"]["cy"]) == (0.0, 2.0, 0.0)


def test_centroid_spaces_differ_slightly(spark):
    tall = box(-100, 30, -99, 40)
    planar = one(spark, tall, shapes.centroid("geom", "planar")["cy"])
    equal = one(spark, tall, shapes.centroid("geom", "equal_area")["cy"])
    assert planar == 35.0 and 34 < equal < 35
    with pytest.raises(ValueError):
        shapes.centroid("geom", "nowhere")


def test_compactness_of_a_square(spark):
    frame = shapes_frame(spark, {"Z": box(-96.01, 37.0, -96.0, 37.008)}, ZONE_SCHEMA)
    assert audit.zone_measures(frame).first()["compactness"] == pytest.approx(math.pi / 4, rel=0.01)


def test_ellipsoid_distance_known_value(spark):
    # one degree of longitude on the equator, and a published Vincenty example
    d = shapes.ellipsoid_distance(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    rows = [(0.0, 0.0, 1.0, 0.0), (144.42486789, -37.95103342, 143.92649553, -37.65282114), (5.0, 5.0, 5.0, 5.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(d).collect()]
    assert got[0] == pytest.approx(111319.4908, abs=1e-3)
    assert got[1] == pytest.approx(54972.271, abs=0.01)
    assert got[2] == 0.0


def test_validity_reasons(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    rows = {
        "ok": polygon(square),
        "bowtie": polygon([(0, 0), (10, 10), (10, 0), (0, 10)]),
        "pinch": polygon([(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)]),
        "hole_ok": polygon(square, [(2, 2), (4, 2), (4, 4)]),
        "hole_out": polygon(square, [(20, 20), (22, 20), (22, 22)]),
        "hole_cross": polygon(square, [(8, 8), (12, 8), (12, 9)]),
        "nested": multipolygon([square], [[(2, 2), (4, 2), (4, 4)]]),
        "apart": multipolygon([square], [[(20, 2), (24, 2), (24, 4)]]),
        "empty": {"kind": "POLYGON", "parts": []},
        "dot_line": line((1, 1), (1, 1)),
        "none": None,
    }
    many = [(math.cos(i / 50 * math.pi) * 10, math.sin(i / 50 * math.pi) * 10) for i in range(100)]
    rows["circle"] = polygon(many)
    rows["tangled"] = polygon([*many[:50], (50, 50), (-50, -60), *many[50:]])
    found = {r[0]: r[1] for r in shapes_frame(spark, rows).select("fid", shapes.validity("geom").alias("v")).collect()}
    reason = {k: v["reason"] if v else None for k, v in found.items()}
    assert [k for k in rows if found[k] and found[k]["valid"]] == ["ok", "hole_ok", "apart", "empty", "circle"]
    assert reason["bowtie"] == reason["hole_cross"] == reason["tangled"] == "Self-intersection"
    assert reason["pinch"] == "Ring Self-intersection"
    assert reason["hole_out"] == "Hole lies outside shell"
    assert reason["nested"] == "Nested shells"
    assert found["none"] is None or found["none"]["valid"] is None


def test_fast_and_general_validity_agree():
    """The batch check of small rings must give the general answer for any ring."""
    rng = np.random.default_rng(5)
    rings = [rng.integers(0, 6, (rng.integers(3, 9), 2)).astype(float) for _ in range(400)]
    rows = [{"kind": "POLYGON", "parts": [[[{"x": x, "y": y} for x, y in [*r, r[0]]]]]} for r in rings]
    kind = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])
    got = kernels.validity(pa.array(rows, kind)).to_pylist()
    want = [kernels._polygon_reason([[np.vstack([r, r[:1]])]]) for r in rings]
    assert [g["valid"] for g in got] == [w is None for w in want]
    assert 0 < sum(g["valid"] for g in got) < 400


def test_layer_audit_counts_missing_invalid_and_empty_apart(spark):
    rows = {"ok": box(0, 0, 1, 1), "tie": polygon([(0, 0), (1, 1), (1, 0), (0, 1)]), "empty": {"kind": "POLYGON", "parts": []}, "none": None}
    frame = shapes_frame(spark, rows).withColumn("name", F.when(F.col("fid") != "ok", F.col("fid")))
    row = audit.layer_audit(frame, F.lit("r"), "l", columns=["name"]).first()
    assert (row["row_count"], row["null_geometry_count"], row["invalid_geometry_count"], row["empty_geometry_count"]) == (4, 1, 1, 1)
    assert row["geometry_type_counts"] == '{"POLYGON":3}' and row["null_pct_by_column"] == '{"name":0.25}'
    failed = audit.failed_layer(audit.layer_audit(frame, F.lit("r"), "l"), "r", "gone", "missing_file", "x" * 9000)
    assert failed.filter("status = 'missing_file'").select(F.length("error_message")).first()[0] == 8000


def test_wkb_round_trip_and_foreign_encodings(spark):
    import struct

    rows = {
        "p": point(1, 2),
        "l": line((0, 0), (1, 2), (3, 3)),
        "a": polygon([(0, 0), (9, 0), (9, 9)], [(5, 1), (6, 1), (6, 2)]),
        "ma": multipolygon([[(0, 0), (2, 0), (2, 2)]], [[(5, 5), (7, 5), (7, 7)]]),
        "ml": multiline([(0, 0), (1, 1)], [(2, 2), (3, 3)]),
        "e": {"kind": "POLYGON", "parts": [[]]},
        "n": None,
    }
    stored = shapes_frame(spark, rows).select("fid", "geom", geo.encode_wkb("geom").alias("geometry"))
    back = stored.select("fid", "geom", geo.decode_wkb("geometry").alias("back")).collect()
    assert all(r["geom"] == r["back"] for r in back)
    big_endian = struct.pack(">BI2d", 0, 1, 3.0, 4.0)
    with_z = struct.pack("<BII6d", 1, 1002, 2, 0.0, 1.0, 9.0, 2.0, 3.0, 9.0)
    with_srid = struct.pack("<BII2d", 1, 1 | 0x20000000, 4326, 5.0, 6.0)
    frame = spark.createDataFrame([(1, bytearray(big_endian)), (2, bytearray(with_z)), (3, bytearray(with_srid))], "i int, geometry binary")
    got = {r["i"]: r for r in geo.decode_geometry(frame).collect()}
    assert (got[1]["xmin"], got[1]["ymin"]) == (3.0, 4.0)
    assert (got[2]["geom"]["kind"], got[2]["xmax"], got[2]["ymax"]) == ("LINE", 2.0, 3.0)
    assert (got[3]["xmin"], got[3]["ymin"]) == (5.0, 6.0)


def test_representative_point_prefers_the_given_one(spark):
    frame = shapes_frame(spark, {"A": box(-100, 30, -99, 31), "B": box(-100, 31, -99, 32)}, ZONE_SCHEMA)
    given = frame.withColumns({"lat": F.when(F.col("zone_id") == "A", 30.1), "lon": F.when(F.col("zone_id") == "A", -99.9)})
    rows = {r["zone_id"]: r for r in audit.representative_points(given, lat="lat", lon="lon").collect()}
    assert (rows["A"]["lat"], rows["A"]["source"]) == (30.1, "given_point")
    assert rows["B"]["source"] == "geometric_centroid" and 31.4 < rows["B"]["lat"] < 31.6
    assert audit.representative_points(frame, lat="lat", lon="lon").filter("source = 'given_point'").count() == 0
