"""Geometry columns and the measures taken on them.

A geometry is ``struct<kind, parts>``: parts hold rings, rings hold points.  A point is
one part with one one-point ring; a line part has one ring (its path); a polygon part
starts with its outer ring and continues with the holes.

Building and taking apart geometries uses Column expressions.  Measures run in vectorised
Arrow kernels: nested higher-order functions are interpreted per element and were 50-100
times slower here.  The kernels are marked non-deterministic only to stop the optimizer
from evaluating them again in every inferred filter.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlay.functions import kernels, types
from coverlay.functions.values import as_column

POINT, LINE, POLYGON = "POINT", "LINE", "POLYGON"

BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def _once(udf):
    return udf.asNondeterministic()


def _xy(x: Column | str | float, y: Column | str | float) -> Column:
    def one(v: Column | str | float) -> Column:
        return (as_column(v) if isinstance(v, (Column, str)) else F.lit(v)).cast("double")

    return F.struct(one(x).alias("x"), one(y).alias("y"))


def make_geom(kind: str, rings: Column) -> Column:
    """One-part geometry from an array of rings."""
    shape = F.struct(F.lit(kind).alias("kind"), F.array(rings).alias("parts"))
    return shape.cast(types.GEOM)


def point_geom(x: Column | str, y: Column | str) -> Column:
    return make_geom(POINT, F.array(F.array(_xy(x, y))))


def line_geom(vertices: Sequence[tuple]) -> Column:
    return make_geom(LINE, F.array(F.array(*[_xy(x, y) for x, y in vertices])))


def polygon_geom(vertices: Sequence[tuple]) -> Column:
    """Polygon without holes; the ring is closed here."""
    ring = [_xy(x, y) for x, y in vertices]
    return make_geom(POLYGON, F.array(F.array(*ring, ring[0])))


def box_geom(xmin, ymin, xmax, ymax) -> Column:
    return polygon_geom([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)])


def points(geom: Column | str) -> Column:
    return F.flatten(F.flatten(as_column(geom)["parts"]))


def segments(geom: Column | str) -> Column:
    """Every edge of every ring, in order, as ``array<struct<x1,y1,x2,y2>>``."""

    def of_ring(ring: Column) -> Column:
        edges = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(
            F.slice(ring, F.lit(1), edges),
            F.slice(ring, F.lit(2), edges),
            lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
        )

    return F.flatten(F.transform(F.flatten(as_column(geom)["parts"]), of_ring))


def is_empty(geom: Column | str) -> Column:
    """True when no coordinate is present; NULL geometry stays NULL (missing is not empty)."""
    geom = as_column(geom)
    return F.when(geom.isNotNull(), F.coalesce(F.size(points(geom)), F.lit(0)) <= 0)


# --- vectorised measures --------------------------------------------------------------------


@_once
@F.arrow_udf(types.MEASURES)
def _planar_measures(geom: pa.Array) -> pa.Array:
    return kernels.measures(geom, projected=False, back=False)


@_once
@F.arrow_udf(types.MEASURES)
def _equal_area_measures(geom: pa.Array) -> pa.Array:
    return kernels.measures(geom, projected=True, back=False)


@_once
@F.arrow_udf(types.MEASURES)
def _equal_area_measures_lonlat_centre(geom: pa.Array) -> pa.Array:
    return kernels.measures(geom, projected=True, back=True)


@_once
@F.arrow_udf(types.DOUBLE)
def ellipsoid_distance(lon1: pa.Array, lat1: pa.Array, lon2: pa.Array, lat2: pa.Array) -> pa.Array:
    """Metres along the WGS84 ellipsoid between two lon/lat points."""
    return kernels.ellipsoid_distance(lon1, lat1, lon2, lat2)


@_once
@F.arrow_udf(types.VALIDITY)
def validity(geom: pa.Array) -> pa.Array:
    """Polygon validity with the first reason found; NULL geometry gives NULL."""
    return kernels.validity(geom)


def measures(geom: Column | str, space: str = "planar", centre_lonlat: bool = False) -> Column:
    """``struct<xmin,ymin,xmax,ymax,n_points,area,length,cx,cy>`` in one pass.

    ``space`` is ``planar`` (the coordinates' own units) or ``equal_area`` (lon/lat in,
    metres out).  ``length`` is the total edge length: a polygon's perimeter.
    """
    if space == "planar":
        return _planar_measures(as_column(geom))
    if space != "equal_area":
        raise ValueError(f"unknown space {space!r}: use 'equal_area' or 'planar'")
    return (_equal_area_measures_lonlat_centre if centre_lonlat else _equal_area_measures)(as_column(geom))


def _only(kind: str, geom: Column, value: Column, what: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"{what} needs {kind} geometry, got "), geom["kind"]))
    return F.when(geom.isNull(), F.lit(None).cast("double")).when(geom["kind"] == kind, value).otherwise(wrong)


def area_m2(geom: Column | str) -> Column:
    """Area of a lon/lat polygon in square metres; another kind is an error, not 0."""
    geom = as_column(geom)
    return _only(POLYGON, geom, measures(geom, "equal_area")["area"], "area")


def length_m(geom: Column | str) -> Column:
    """Length of a lon/lat line in metres; a polygon is an error, not its perimeter."""
    geom = as_column(geom)
    return _only(LINE, geom, measures(geom, "equal_area")["length"], "length")


def centroid(geom: Column | str, space: str = "equal_area") -> Column:
    """Measures whose ``cx, cy`` are the centroid in the input's coordinates.

    ``equal_area`` projects lon/lat, takes the centroid there and projects back; ``planar``
    averages degrees directly.  The two differ slightly, so callers choose.
    """
    return measures(geom, space, centre_lonlat=space == "equal_area")


def compactness(area: Column | str, perimeter: Column | str) -> Column:
    """``4 pi A / P^2``: 1 for a circle, towards 0 for slivers."""
    area, around = as_column(area), as_column(perimeter)
    return F.when(around > 0, 4 * F.pi() * area / (around * around))
