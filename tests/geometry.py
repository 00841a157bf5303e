"""Small geometries for tests, as Spark rows."""

from coverlay.functions import types

ZONE_SCHEMA = types.struct(zone_id=types.TEXT, geom=types.GEOM)
SHAPE_SCHEMA = types.struct(fid=types.TEXT, geom=types.GEOM)


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def closed(points):
    return ring([*points, points[0]])


def polygon(*rings):
    """One part: outer ring, then holes; rings are closed here."""
    return {"kind": "POLYGON", "parts": [[closed(r) for r in rings]]}


def multipolygon(*parts):
    return {"kind": "POLYGON", "parts": [[closed(r) for r in part] for part in parts]}


def line(*points):
    return {"kind": "LINE", "parts": [[ring(points)]]}


def multiline(*paths):
    return {"kind": "LINE", "parts": [[ring(p)] for p in paths]}


def point(x, y):
    return {"kind": "POINT", "parts": [[ring([(x, y)])]]}


def box(x1, y1, x2, y2):
    return polygon([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])


def shapes_frame(spark, rows, schema=SHAPE_SCHEMA):
    return spark.createDataFrame([(name, geom) for name, geom in rows.items()], schema)


def two_zones(spark):
    return shapes_frame(spark, {"T1": box(0, 0, 10, 10), "T2": box(10, 0, 20, 10)}, ZONE_SCHEMA)
