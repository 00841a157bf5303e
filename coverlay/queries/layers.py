"""The given tables seen as map layers.

The tables hold no geometry, so every layer derives it from keys, identically in Spark and
in the SQL fragments below (used by the checks).  Whole tables are used throughout.

* zones: ``nation`` as 25 squares of side 20 covering [0, 100] x [0, 100]
* places: ``orders`` as points, some exactly on zone borders
* footprints: ``lineitem`` as axis-aligned boxes, many straddling borders
* roads: ``orders`` as segments, some touching a zone only at its corner
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlay.functions import geodesy, kernels, shapes
from coverlay.operators.spatial_join import ZoneIndex
from coverlay.operators.spread import spread
from coverlay.sources.row_ids import read_numbered

SIDE = 20.0
PLACE_ID = ["o_orderkey"]
FOOTPRINT_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# Lon/lat placement of the plane, for the projected measures.
LON0, LON_STEP = -120.0, 4.0
LAT0, LAT_STEP = 30.0, 10.0
OFF_RASTER = 0.0037


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lon(x: Column) -> Column:
    return F.lit(LON0) + x / LON_STEP


def _lat(y: Column) -> Column:
    return F.lit(LAT0) + y / LAT_STEP


def _spread_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spread(table(spark, sf_dir, name).select(*columns))


def zones(spark: SparkSession, sf_dir: str, lonlat: bool = False) -> DataFrame:
    key = F.col("n_nationkey")
    x0 = (key % 5).cast("double") * SIDE
    y0 = F.floor(key / 5).cast("double") * SIDE
    corners = (x0, y0, x0 + SIDE, y0 + SIDE)
    if lonlat:
        corners = (_lon(corners[0]), _lat(corners[1]), _lon(corners[2]), _lat(corners[3]))
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")
    )
    return (
        table(spark, sf_dir, "nation")
        .join(regions, "n_regionkey")
        .select(
            F.lpad(key.cast("string"), 11, "0").alias("zone_id"),
            "region",
            "n_nationkey",
            shapes.box_geom(*corners).alias("geom"),
        )
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as small square zones, many of them within one zone of ``nation``."""
    key = F.col("s_suppkey")
    x, y = (key * 7919) % 10000 / 100.0, (key * 104729) % 10000 / 100.0
    side = (key % 5 + 1) / 8.0
    return table(spark, sf_dir, "supplier").select(
        F.lpad(key.cast("string"), 11, "0").alias("zone_id"), "s_nationkey", shapes.box_geom(x, y, x + side, y + side).alias("geom")
    )


def zone_index(spark: SparkSession, sf_dir: str, lonlat: bool = False) -> ZoneIndex:
    """Zones ready for joins."""
    return ZoneIndex(zones(spark, sf_dir, lonlat))


PLACE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


def places(spark: SparkSession, sf_dir: str, lonlat: bool = False, numbered: bool = False) -> DataFrame:
    """``numbered`` adds ``row_id``, the number of the stored row."""
    key = F.col("o_orderkey")
    x, y = (key * 7919) % 10000 / 100.0, (key * 104729) % 10000 / 100.0
    if lonlat:
        x, y = _lon(x), _lat(y)
    if numbered:
        orders = spread(read_numbered(spark, f"{sf_dir}/orders.parquet", PLACE_COLUMNS))
    else:
        orders = _spread_table(spark, sf_dir, "orders", PLACE_COLUMNS)
    return orders.select("*", x.alias("x"), y.alias("y"))


def footprints(spark: SparkSession, sf_dir: str, lonlat: bool = False) -> DataFrame:
    x = (F.col("l_partkey") * 7919) % 10000 / 100.0
    y = (F.col("l_suppkey") * 104729 + F.col("l_orderkey") * 31) % 10000 / 100.0
    h = F.lit(0.2) + (F.col("l_partkey") % 7) / 10.0
    corners = (x - h, y - h, x + h, y + h)
    if lonlat:
        # off the 0.01 raster, so that no projected centroid falls exactly on a border
        corners = tuple(c + OFF_RASTER for c in corners)
        corners = (_lon(corners[0]), _lat(corners[1]), _lon(corners[2]), _lat(corners[3]))
    lineitem = _spread_table(
        spark, sf_dir, "lineitem", [*FOOTPRINT_ID, "l_returnflag", "l_linestatus", "l_quantity"]
    )
    return lineitem.select(
        *FOOTPRINT_ID, "l_returnflag", "l_linestatus", "l_quantity",
        *[c.alias(n) for n, c in zip(shapes.BOUNDS, corners)],
        shapes.box_geom(*corners).alias("geom"),
    )


def roads(spark: SparkSession, sf_dir: str, lonlat: bool = False) -> DataFrame:
    """With ``metres``, the length in the equal-area plane, whatever the coordinates."""
    p = places(spark, sf_dir)
    x2 = F.col("x") + ((F.col("o_custkey") % 41) - 20) / 2.0
    y2 = F.col("y") + ((F.col("o_custkey") % 37) - 18) / 2.0
    ends = [(F.col("x"), F.col("y")), (x2, y2)]
    degrees = [(_lon(x), _lat(y)) for x, y in ends]
    (ax, ay), (bx, by) = (geodesy.equal_area_xy(*end) for end in degrees)
    return p.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        shapes.line_geom(degrees if lonlat else ends).alias("geom"), F.hypot(bx - ax, by - ay).alias("metres"),
    )


# --- the same layers as SQL, for the checks ------------------------------------------------

ZONES_SQL = """
z AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 11, '0') AS zone_id, r_name AS region, n_nationkey,
         CAST((n_nationkey % 5) * 20 AS DOUBLE) AS x0,
         CAST((n_nationkey // 5) * 20 AS DOUBLE) AS y0
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

PLOTS_SQL = """
s AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS plot_id, s_nationkey, sx, sy, (s_suppkey % 5 + 1)::DOUBLE / 8.0::DOUBLE AS side FROM (
    SELECT *, ((s_suppkey * 7919) % 10000)::DOUBLE / 100.0::DOUBLE AS sx, ((s_suppkey * 104729) % 10000)::DOUBLE / 100.0::DOUBLE AS sy FROM supplier)
)"""

PLACES_SQL = """
p AS (
  SELECT *, ((o_orderkey * 7919) % 10000)::DOUBLE / 100.0::DOUBLE AS px,
            ((o_orderkey * 104729) % 10000)::DOUBLE / 100.0::DOUBLE AS py
  FROM orders
)"""

FOOTPRINTS_SQL = """
b AS (
  SELECT *, cx - h AS bx1, cy - h AS by1, cx + h AS bx2, cy + h AS by2 FROM (
    SELECT *, ((l_partkey * 7919) % 10000)::DOUBLE / 100.0::DOUBLE AS cx,
              ((l_suppkey * 104729 + l_orderkey * 31) % 10000)::DOUBLE / 100.0::DOUBLE AS cy,
              0.2::DOUBLE + (l_partkey % 7)::DOUBLE / 10.0::DOUBLE AS h
    FROM lineitem)
)"""

ROADS_SQL = """
r AS (
  SELECT *, px + ((o_custkey % 41) - 20)::DOUBLE / 2.0::DOUBLE AS qx,
            py + ((o_custkey % 37) - 18)::DOUBLE / 2.0::DOUBLE AS qy
  FROM p
)"""

# Liang-Barsky against each square: entry and exit parameters of the closed box.
CLIPPED_SQL = """
lb AS (
  SELECT *, greatest(0.0::DOUBLE, tx1, ty1) AS t0, least(1.0::DOUBLE, tx2, ty2) AS t1 FROM (
    SELECT *,
      CASE WHEN dx = 0 THEN CASE WHEN px BETWEEN x0 AND x0 + 20 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END
           ELSE least((x0 - px) / dx, (x0 + 20 - px) / dx) END AS tx1,
      CASE WHEN dx = 0 THEN CASE WHEN px BETWEEN x0 AND x0 + 20 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
           ELSE greatest((x0 - px) / dx, (x0 + 20 - px) / dx) END AS tx2,
      CASE WHEN dy = 0 THEN CASE WHEN py BETWEEN y0 AND y0 + 20 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END
           ELSE least((y0 - py) / dy, (y0 + 20 - py) / dy) END AS ty1,
      CASE WHEN dy = 0 THEN CASE WHEN py BETWEEN y0 AND y0 + 20 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
           ELSE greatest((y0 - py) / dy, (y0 + 20 - py) / dy) END AS ty2
    FROM (SELECT *, qx - px AS dx, qy - py AS dy FROM r) r2
    JOIN z ON least(px, qx) <= x0 + 20 AND greatest(px, qx) >= x0
          AND least(py, qy) <= y0 + 20 AND greatest(py, qy) >= y0
    WHERE dx <> 0 OR dy <> 0)
)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts)


# Equal-area projection, and back, of the columns lon/lat and x/y of an inner query.
def projected_sql(inner: str) -> str:
    """Add ``x, y`` (metres) to a query with ``lon, lat`` (degrees)."""
    g = geodesy
    return f"""
  SELECT *, rho * sin(theta) AS x, {g.RHO_ORIGIN!r}::DOUBLE - rho * cos(theta) AS y FROM (
   SELECT *, {g.SEMI_MAJOR_M!r}::DOUBLE * sqrt({g.CONE_C!r}::DOUBLE - {g.CONE!r}::DOUBLE * q) / {g.CONE!r}::DOUBLE AS rho,
          {g.CONE!r}::DOUBLE * radians(lon - ({g.ORIGIN_LON_DEG!r}::DOUBLE)) AS theta FROM (
    SELECT *, {1 - g.E2!r}::DOUBLE * (s / (1 - es * es) - ln((1 - es) / (1 + es)) / {2 * g.E1!r}::DOUBLE) AS q FROM (
     SELECT *, sin(radians(lat)) AS s, {g.E1!r}::DOUBLE * sin(radians(lat)) AS es FROM ({inner}))))"""


def unprojected_sql(inner: str) -> str:
    """Add ``lon, lat`` (degrees) to a query with ``x, y`` (metres); iterated to convergence."""
    g = geodesy
    steps = f"""
   SELECT *, asin(qq / {g.Q_POLE!r}::DOUBLE) AS phi0, atan2(x, {g.RHO_ORIGIN!r}::DOUBLE - y) AS th FROM (
    SELECT *, ({g.CONE_C!r}::DOUBLE - (x * x + ({g.RHO_ORIGIN!r}::DOUBLE - y) * ({g.RHO_ORIGIN!r}::DOUBLE - y))
       * {g.CONE / g.SEMI_MAJOR_M!r}::DOUBLE * {g.CONE / g.SEMI_MAJOR_M!r}::DOUBLE) / {g.CONE!r}::DOUBLE AS qq FROM ({inner}))"""
    for i in range(4):
        e = f"({g.E1!r}::DOUBLE * sin(phi{i}))"
        steps = f"""
   SELECT *, phi{i} + (1 - {e} * {e}) * (1 - {e} * {e}) / (2 * cos(phi{i}))
     * (qq / {1 - g.E2!r}::DOUBLE - sin(phi{i}) / (1 - {e} * {e}) + ln((1 - {e}) / (1 + {e})) / {2 * g.E1!r}::DOUBLE) AS phi{i + 1}
   FROM ({steps})"""
    return f"SELECT *, {g.ORIGIN_LON_DEG!r}::DOUBLE + degrees(th / {g.CONE!r}::DOUBLE) AS lon, degrees(phi4) AS lat FROM ({steps})"


def geodesic_sql(inner: str, steps: int = 6) -> str:
    """Add ``metres`` on the ellipsoid to a query with ``lon1, lat1, lon2, lat2`` (degrees).

    Vincenty's inverse formula with its iteration written out; segments this short settle in
    three steps.
    """
    f, a = f"{kernels.WGS84_F!r}::DOUBLE", f"{kernels.WGS84_A!r}::DOUBLE"
    sql = f"""SELECT *, l0 AS lam, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM (
      SELECT *, radians(lon2 - lon1) AS l0, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2 FROM ({inner}))"""
    for _ in range(steps):
        sql = f"""SELECT * REPLACE (l0 + (1 - cc) * {f} * sa * (sg + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))) AS lam) FROM (
        SELECT *, CASE WHEN c2a > 0 THEN cs - 2 * s1 * s2 / c2a ELSE 0 END AS c2m, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS cc FROM (
        SELECT *, 1 - sa * sa AS c2a FROM (
        SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM (
        SELECT *, sqrt(c2 * sin(lam) * c2 * sin(lam) + (c1 * s2 - s1 * c2 * cos(lam)) * (c1 * s2 - s1 * c2 * cos(lam))) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs
        FROM (SELECT lon1, lat1, lon2, lat2, l0, lam, s1, c1, s2, c2, rest FROM ({sql}))))))"""
    b = f"({a} * (1 - {f}))"
    return f"""SELECT rest, {b} * ba * (sg - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) AS metres FROM (
      SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS ba, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb FROM (
      SELECT *, c2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS q FROM ({sql})))"""


LAYER_SQL = {"z": ZONES_SQL, "s": PLOTS_SQL, "p": PLACES_SQL, "b": FOOTPRINTS_SQL, "r": ROADS_SQL, "lb": CLIPPED_SQL}


def layers_sql(names: str) -> str:
    """``WITH`` clause for the named layers, e.g. ``layers_sql("z p")``."""
    return with_sql(*[LAYER_SQL[n] for n in names.split()])
