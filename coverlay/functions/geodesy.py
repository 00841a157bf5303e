"""Equal-area projection (Albers conic on GRS80) and its inverse as Column expressions.

Closed form from the published map-projection formulas, so no projection library is
needed and the arithmetic stays in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlay.functions.values import as_column

# GRS80 ellipsoid and the CONUS equal-area parameters.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257222101
STANDARD_PARALLELS_DEG = (29.5, 45.5)
ORIGIN_LAT_DEG = 23.0
ORIGIN_LON_DEG = -96.0

E2 = 2 * FLATTENING - FLATTENING**2
E1 = math.sqrt(E2)


def _q(sin_lat: float) -> float:
    es = E1 * sin_lat
    return (1 - E2) * (sin_lat / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * E1))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)


_LAT1, _LAT2 = (math.radians(v) for v in STANDARD_PARALLELS_DEG)
CONE = (_m(_LAT1) ** 2 - _m(_LAT2) ** 2) / (_q(math.sin(_LAT2)) - _q(math.sin(_LAT1)))
CONE_C = _m(_LAT1) ** 2 + CONE * _q(math.sin(_LAT1))
RHO_ORIGIN = SEMI_MAJOR_M * math.sqrt(CONE_C - CONE * _q(math.sin(math.radians(ORIGIN_LAT_DEG)))) / CONE
Q_POLE = _q(1.0)


# The formulas take the function namespace ``m`` as argument: ``pyspark.sql.functions`` for
# Columns, ``numpy`` inside vectorised kernels.


def project(m, lon, lat):
    """Lon/lat degrees to equal-area metres ``(x, y)``."""
    s = m.sin(m.radians(lat))
    es = s * E1
    q = (1 - E2) * (s / (1 - es * es) - m.log((1 - es) / (1 + es)) / (2 * E1))
    rho = SEMI_MAJOR_M * m.sqrt(CONE_C - CONE * q) / CONE
    theta = CONE * m.radians(lon - ORIGIN_LON_DEG)
    return rho * m.sin(theta), RHO_ORIGIN - rho * m.cos(theta)


def unproject(m, x, y):
    """Equal-area metres back to degrees: authalic-latitude series plus one Newton step."""
    theta = m.atan2(x, RHO_ORIGIN - y)
    scaled = m.hypot(x, RHO_ORIGIN - y) * (CONE / SEMI_MAJOR_M)
    q = (CONE_C - scaled * scaled) / CONE
    beta = m.asin(q / Q_POLE)
    e4, e6 = E2**2, E2**3
    lat = (
        beta
        + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta)
        + (761 * e6 / 45360) * m.sin(6 * beta)
    )
    s = m.sin(lat)
    es = s * E1
    rest = 1 - es * es
    step = (rest * rest / (2 * m.cos(lat))) * (
        q / (1 - E2) - s / rest + m.log((1 - es) / (1 + es)) / (2 * E1)
    )
    return ORIGIN_LON_DEG + m.degrees(theta / CONE), m.degrees(lat + step)


def equal_area_xy(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    return project(F, as_column(lon), as_column(lat))


def lonlat_of(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    return unproject(F, as_column(x), as_column(y))
