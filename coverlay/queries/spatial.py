"""Spatial joins, measures and geometry audits on the derived layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlay.functions import geodesy, shapes
from coverlay.operators import spatial_join as sj
from coverlay.operators.contracts import contract_report
from coverlay.operators.features import onto_zones
from coverlay.operators.lineage import settle, shared_folder
from coverlay.operators.ordering import exact_quantiles
from coverlay.operators.sets import union_scopes
from coverlay.plans import audit
from coverlay.queries import layers as L
from coverlay.queries.registry import query
from coverlay.sources import geo, layout, tables
from coverlay.sources.contracts import LAYER_CONTRACTS
from coverlay.sources.row_ids import read_numbered

SQUARE_IN = "px > x0 AND px < x0 + 20 AND py > y0 AND py < y0 + 20"
SQUARE_ON = "px >= x0 AND px <= x0 + 20 AND py >= y0 AND py <= y0 + 20"
BOX_MEETS = "bx1 <= x0 + 20 AND bx2 >= x0 AND by1 <= y0 + 20 AND by2 >= y0"
# Centroid of a box in the same order of operations as the general area-weighted formula.
BOX_CENTRE = """
c AS (
  SELECT *, bx1 + ((w + w) * wg + (w + 0) * wg) / (3 * (wg + wg)) AS mx,
            by1 + ((0 + g) * wg + (g + g) * wg) / (3 * (wg + wg)) AS my
  FROM (SELECT *, bx2 - bx1 AS w, by2 - by1 AS g, (bx2 - bx1) * (by2 - by1) AS wg FROM b)
)"""
CENTRE_IN = "mx > x0 AND mx < x0 + 20 AND my > y0 AND my < y0 + 20"


@query(
    "points_in_zones",
    L.layers_sql("z p")
    + f" SELECT zone_id, region, count(o_orderkey)::BIGINT AS n FROM z LEFT JOIN p ON {SQUARE_IN} GROUP BY ALL",
)
def points_in_zones(spark: SparkSession, d: str) -> DataFrame:
    index = L.zone_index(spark, d)
    counts = sj.assign_points(L.places(spark, d), index).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))
    return onto_zones(index.zones.select("zone_id", "region"), [counts], "zone_id", zero=["n"])


@query(
    "places_by_class",
    L.layers_sql("z p")
    + f""" SELECT zone_id, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS n_urgent,
      count(*) FILTER (o_orderpriority IN ('2-HIGH', '3-MEDIUM'))::BIGINT AS n_middle, count(*)::BIGINT AS n_all
      FROM z JOIN p ON {SQUARE_IN} GROUP BY ALL""",
)
def places_by_class(spark: SparkSession, d: str) -> DataFrame:
    level = F.col("o_orderpriority")
    counts = {"n_urgent": level == "1-URGENT", "n_middle": level.isin("2-HIGH", "3-MEDIUM"), "n_all": F.lit(True)}
    return sj.count_points_where(L.places(spark, d), L.zone_index(spark, d), counts)


@query(
    "buildings_by_centroid",
    L.layers_sql("z b")
    + f", {BOX_CENTRE} SELECT zone_id, l_returnflag, count(*)::BIGINT AS n FROM z JOIN c ON {CENTRE_IN} GROUP BY ALL",
)
def buildings_by_centroid(spark: SparkSession, d: str) -> DataFrame:
    placed = sj.assign_by_centroid(L.footprints(spark, d), L.zone_index(spark, d), centroid_space="planar")
    return placed.groupBy("zone_id", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "buildings_by_equal_area_centroid",
    L.layers_sql("z b")
    + f""" SELECT zone_id, count(*)::BIGINT AS n FROM z
      JOIN (SELECT *, cx + {L.OFF_RASTER} AS mx, cy + {L.OFF_RASTER} AS my FROM b) c ON {CENTRE_IN} GROUP BY ALL""",
)
def buildings_by_equal_area_centroid(spark: SparkSession, d: str) -> DataFrame:
    placed = sj.assign_by_centroid(L.footprints(spark, d, lonlat=True), L.zone_index(spark, d, lonlat=True))
    return placed.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "buildings_intersect_zones",
    L.layers_sql("z b") + f" SELECT zone_id, l_returnflag, count(*)::BIGINT AS n FROM z JOIN b ON {BOX_MEETS} GROUP BY ALL",
)
def buildings_intersect_zones(spark: SparkSession, d: str) -> DataFrame:
    kept = [*L.FOOTPRINT_ID, "l_returnflag"]
    pairs = sj.polygon_pairs(L.footprints(spark, d), L.zone_index(spark, d), L.FOOTPRINT_ID, keep=kept)
    return sj.count_pairs(pairs, L.FOOTPRINT_ID, ["zone_id", "l_returnflag"])


@query(
    "straddling_buildings",
    L.layers_sql("z b")
    + f""" SELECT n_zones, count(*)::BIGINT AS n_buildings FROM (
      SELECT count(*)::BIGINT AS n_zones FROM z JOIN b ON {BOX_MEETS}
      GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) GROUP BY ALL""",
)
def straddling_buildings(spark: SparkSession, d: str) -> DataFrame:
    found = sj.features_by_zones(L.footprints(spark, d), L.zone_index(spark, d), L.FOOTPRINT_ID)
    return found.withColumnRenamed("n", "n_buildings")


@query(
    "large_features_in_plots",
    L.layers_sql("z s")
    + """ SELECT z.zone_id AS district, plot_id FROM z JOIN s ON sx <= x0 + 20 AND sx + side >= x0 AND sy <= y0 + 20 AND sy + side >= y0""",
)
def large_features_in_plots(spark: SparkSession, d: str) -> DataFrame:
    """Features many times the zones' size: covered by cells that follow their border."""
    districts = L.zones(spark, d).select(F.col("zone_id").alias("district"), "geom")
    pairs = sj.assign_by_intersection(districts, sj.ZoneIndex(L.plots(spark, d)), ["district"])
    return pairs.select("district", F.col("zone_id").alias("plot_id"))


@query(
    "line_clip_length",
    L.layers_sql("z p r lb")
    + """ SELECT zone_id, o_orderstatus, round(sum((t1 - t0) * sqrt(dx * dx + dy * dy)), 4) AS length
      FROM lb WHERE t1 - t0 > 1e-12 GROUP BY ALL""",
)
def line_clip_length(spark: SparkSession, d: str) -> DataFrame:
    lengths = sj.clipped_length(
        L.roads(spark, d), L.zone_index(spark, d), L.PLACE_ID, by=["o_orderstatus"], measure="planar"
    )
    return lengths.withColumn("length", F.round("length", 4))


@query(
    "line_clip_pairs",
    L.layers_sql("z p r lb")
    + """ SELECT o_orderkey, zone_id, round((t1 - t0) * sqrt(dx * dx + dy * dy), 6) AS length
      FROM lb WHERE t1 - t0 > 1e-12""",
)
def line_clip_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = sj.clip_lines(L.roads(spark, d), L.zone_index(spark, d), L.PLACE_ID)
    total = F.aggregate("clipped", F.lit(0.0), lambda acc, s: acc + sj.planar_measure(s))
    return pairs.select("o_orderkey", "zone_id", F.round(total, 6).alias("length"))


@query(
    "line_touch_length",
    L.layers_sql("z p r lb")
    + """ SELECT zone_id, round(sum(sqrt(dx * dx + dy * dy)), 4) AS length FROM lb WHERE t1 >= t0 GROUP BY ALL""",
)
def line_touch_length(spark: SparkSession, d: str) -> DataFrame:
    length = shapes.measures("geom")["length"]
    lengths = sj.touched_length(L.roads(spark, d), L.zone_index(spark, d), L.PLACE_ID, length)
    return lengths.withColumn("length", F.round("length", 4))


@query(
    "touch_vs_clip_defined",
    L.layers_sql("z p r lb")
    + """, q AS (SELECT zone_id, bool_or(t1 >= t0) AS touched,
        sum(CASE WHEN t1 - t0 > 1e-12 THEN (t1 - t0) * sqrt(dx * dx + dy * dy) ELSE 0 END) AS length
        FROM lb GROUP BY 1)
      SELECT region, count(*)::BIGINT AS n_zones,
        count(*) FILTER (NOT coalesce(touched, false))::BIGINT AS undefined_by_touch,
        count(*) FILTER (coalesce(length, 0) <= 0)::BIGINT AS undefined_by_length,
        count(*) FILTER (length > 0 AND length < 10)::BIGINT AS near_zero
      FROM z LEFT JOIN q USING (zone_id) GROUP BY ALL""",
)
def touch_vs_clip_defined(spark: SparkSession, d: str) -> DataFrame:
    index = L.zone_index(spark, d)
    return audit.definedness(L.roads(spark, d), index, index.zones, L.PLACE_ID, measure="planar")


WINDOW = (30.0, 20.0, 45.5, 50.25)


@query(
    "window_read",
    L.layers_sql("b")
    + """ SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS quantity FROM b
      WHERE bx1 <= 45.5 AND bx2 >= 30.0 AND by1 <= 50.25 AND by2 >= 20.0 GROUP BY ALL""",
)
def window_read(spark: SparkSession, d: str) -> DataFrame:
    hits = sj.window_read(L.footprints(spark, d), *WINDOW)
    return hits.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(
    "window_read_stored",
    L.layers_sql("b")
    + """ SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS quantity FROM b
      WHERE bx1 <= 45.5 AND bx2 >= 30.0 AND by1 <= 50.25 AND by2 >= 20.0 GROUP BY ALL""",
)
def window_read_stored(spark: SparkSession, d: str) -> DataFrame:
    """The layer written in the order of a curve, and a window of it read back."""
    folder = shared_folder(spark, "layer")
    layout.write_layer(L.footprints(spark, d).drop("geom"), folder, row_group_bytes=256 * 1024)
    hits = geo.read_window(spark, folder, *WINDOW)
    return hits.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(
    "one_zone_features",
    L.layers_sql("z b")
    + f""" SELECT zone_id, l_returnflag, count(*)::BIGINT AS n FROM z JOIN b ON {BOX_MEETS}
      WHERE n_nationkey = 12 GROUP BY ALL""",
)
def one_zone_features(spark: SparkSession, d: str) -> DataFrame:
    target = L.zones(spark, d).filter("n_nationkey = 12")
    pairs = sj.features_of_zone(L.footprints(spark, d), target, L.FOOTPRINT_ID, keep=[*L.FOOTPRINT_ID, "l_returnflag"])
    return sj.count_pairs(pairs, L.FOOTPRINT_ID, ["zone_id", "l_returnflag"])


@query(
    "centroid_in_neighbour",
    L.layers_sql("z b")
    + f""", {BOX_CENTRE} SELECT z.zone_id, h.zone_id AS home, count(*)::BIGINT AS n
      FROM z JOIN c ON {BOX_MEETS}
      JOIN z h ON mx > h.x0 AND mx < h.x0 + 20 AND my > h.y0 AND my < h.y0 + 20 AND h.zone_id <> z.zone_id GROUP BY ALL""",
)
def centroid_in_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return audit.centroids_moved(L.footprints(spark, d), L.zone_index(spark, d), L.FOOTPRINT_ID, centroid_space="planar")


@query(
    "centroid_explain",
    L.layers_sql("z b")
    + f""", {BOX_CENTRE} SELECT z.zone_id, l_returnflag, count(*)::BIGINT AS intersecting,
        count(*) FILTER (h.zone_id = z.zone_id)::BIGINT AS centroid_within,
        count(*) FILTER (h.zone_id <> z.zone_id)::BIGINT AS centroid_elsewhere,
        count(*) FILTER (h.zone_id IS NULL)::BIGINT AS centroid_nowhere
      FROM z JOIN c ON {BOX_MEETS}
      LEFT JOIN z h ON mx > h.x0 AND mx < h.x0 + 20 AND my > h.y0 AND my < h.y0 + 20 GROUP BY ALL""",
)
def centroid_explain(spark: SparkSession, d: str) -> DataFrame:
    return audit.centroid_explain(
        L.footprints(spark, d), L.zone_index(spark, d), L.FOOTPRINT_ID, "l_returnflag", centroid_space="planar"
    )


@query(
    "centroid_explain_gaps",
    L.layers_sql("z b")
    + f""", {BOX_CENTRE}, n AS (
      SELECT z.zone_id, count(*) FILTER (l_returnflag = 'A') AS oi, count(*) FILTER (l_returnflag = 'R') AS ri,
        count(*) FILTER (l_returnflag = 'A' AND {CENTRE_IN}) AS oc,
        count(*) FILTER (l_returnflag = 'R' AND {CENTRE_IN}) AS rc
      FROM z JOIN c ON {BOX_MEETS} GROUP BY 1)
      SELECT zone_id, round(CASE WHEN rc > 0 THEN 1 - least(1.0::DOUBLE, oc / rc) END, 6) AS gap_centroid,
        round(CASE WHEN ri > 0 THEN 1 - least(1.0::DOUBLE, oi / ri) END, 6) AS gap_intersecting FROM n""",
)
def centroid_explain_gaps(spark: SparkSession, d: str) -> DataFrame:
    gaps = audit.explain_gaps(centroid_explain(spark, d), "l_returnflag", "A", "R")
    return gaps.select("zone_id", *[F.round(c, 6).alias(c) for c in ("gap_centroid", "gap_intersecting")])


@query(
    "boundary_audit",
    L.layers_sql("z p")
    + f""", f AS (SELECT *, EXISTS (SELECT 1 FROM z WHERE {SQUARE_IN}) AS inside,
        EXISTS (SELECT 1 FROM z WHERE {SQUARE_ON}) AS touching FROM p)
      SELECT o_orderstatus, count(*)::BIGINT AS total, count(*) FILTER (inside)::BIGINT AS within,
        count(*) FILTER (touching AND NOT inside)::BIGINT AS boundary_only,
        count(*) FILTER (NOT touching)::BIGINT AS outside,
        round(100.0::DOUBLE * count(*) FILTER (touching AND NOT inside) / count(*), 6) AS boundary_pct
      FROM f GROUP BY ALL""",
)
def boundary_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = sj.boundary_audit(L.places(spark, d), L.zone_index(spark, d), L.PLACE_ID, ["o_orderstatus"])
    return rows.withColumn("boundary_pct", F.round("boundary_pct", 6))


@query("row_ids", "SELECT o_orderkey, row_number() OVER ()::BIGINT AS row_id FROM orders")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    """The number of each stored row, whatever the splits of the scan."""
    return read_numbered(spark, f"{d}/orders.parquet", ["o_orderkey"])


@query(
    "boundary_audit_by_row",
    L.layers_sql("z p")
    + f""", n AS (SELECT *, row_number() OVER () AS row_id FROM p),
      f AS (SELECT row_id, any_value(o_orderstatus) AS o_orderstatus, bool_or(coalesce({SQUARE_IN}, false)) AS inside, count(x0) > 0 AS touching
        FROM n LEFT JOIN z ON {SQUARE_ON} GROUP BY row_id)
      SELECT o_orderstatus, count(*)::BIGINT AS total, count(*) FILTER (inside)::BIGINT AS within,
        count(*) FILTER (touching AND NOT inside)::BIGINT AS boundary_only, count(*) FILTER (NOT touching)::BIGINT AS outside
      FROM f GROUP BY ALL""",
)
def boundary_audit_by_row(spark: SparkSession, d: str) -> DataFrame:
    """The exact path, for zones that may overlap: EXISTS and NOT EXISTS by stored row."""
    rows = sj.boundary_audit(L.places(spark, d, numbered=True), L.zone_index(spark, d), ["row_id"], ["o_orderstatus"], disjoint=False)
    return rows.drop("boundary_pct")


@query(
    "distance_to_boundary",
    L.layers_sql("z p")
    + f""" SELECT o_orderkey, zone_id, round(least(px - x0, x0 + 20 - px, py - y0, y0 + 20 - py), 6) AS distance
      FROM z JOIN p ON {SQUARE_IN}""",
)
def distance_to_boundary(spark: SparkSession, d: str) -> DataFrame:
    placed = sj.distance_to_boundary(L.places(spark, d), L.zone_index(spark, d), projected=False)
    return placed.select("o_orderkey", "zone_id", F.round("boundary_distance", 6).alias("distance"))


CORNERS = """SELECT zone_id, k, -120.0::DOUBLE + (x0 + ox) / 4 AS lon, 30.0::DOUBLE + (y0 + oy) / 10 AS lat
  FROM z, (VALUES (0, 0, 0), (1, 20, 0), (2, 20, 20), (3, 0, 20), (4, 0, 0)) o(k, ox, oy)"""
EDGES = f"""
e AS (SELECT a.zone_id, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y
  FROM ({L.projected_sql(CORNERS)}) a JOIN ({L.projected_sql(CORNERS)}) b ON a.zone_id = b.zone_id AND b.k = a.k + 1)"""


@query(
    "distance_to_boundary_m",
    L.layers_sql("z p")
    + f""", {EDGES}, pp AS ({L.projected_sql(f"SELECT o_orderkey, zone_id, -120.0::DOUBLE + px / 4 AS lon, 30.0::DOUBLE + py / 10 AS lat FROM z JOIN p ON {SQUARE_IN}")}),
      t AS (SELECT o_orderkey, pp.zone_id, x, y, ax, ay, bx - ax AS ex, b_y - ay AS ey,
          least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay))
            / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS u FROM pp JOIN e USING (zone_id)),
      m AS (SELECT o_orderkey, zone_id, min(sqrt((x - ax - u * ex) * (x - ax - u * ex) + (y - ay - u * ey) * (y - ay - u * ey))) AS dist FROM t GROUP BY ALL)
      SELECT zone_id, count(*)::BIGINT AS n, round(avg(dist), 3) AS mean_m, round(max(dist), 3) AS max_m FROM m GROUP BY ALL""",
)
def distance_to_boundary_m(spark: SparkSession, d: str) -> DataFrame:
    measured = sj.distance_to_boundary(L.places(spark, d, lonlat=True), L.zone_index(spark, d, lonlat=True))
    dist = F.col("boundary_distance")
    return measured.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(dist), 3).alias("mean_m"), F.round(F.max(dist), 3).alias("max_m")
    )


@query(
    "equal_area_points",
    L.layers_sql("p")
    + f""" SELECT o_orderstatus, count(*)::BIGINT AS n, round(avg(x), 3) AS mean_x, round(avg(y), 3) AS mean_y,
      round(min(x), 3) AS min_x, round(max(y), 3) AS max_y
      FROM ({L.projected_sql("SELECT o_orderstatus, -120.0::DOUBLE + px / 4 AS lon, 30.0::DOUBLE + py / 10 AS lat FROM p")}) GROUP BY ALL""",
)
def equal_area_points(spark: SparkSession, d: str) -> DataFrame:
    x, y = geodesy.equal_area_xy("x", "y")
    projected = L.places(spark, d, lonlat=True).select("o_orderstatus", x.alias("px"), y.alias("py"))
    return projected.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("px"), 3).alias("mean_x"),
        F.round(F.avg("py"), 3).alias("mean_y"),
        F.round(F.min("px"), 3).alias("min_x"),
        F.round(F.max("py"), 3).alias("max_y"),
    )


ZONE_MOMENTS = f""", {EDGES},
  o AS (SELECT zone_id, ax AS ox, ay AS oy FROM e WHERE k = 0),
  m AS (SELECT zone_id, any_value(ox) AS ox, any_value(oy) AS oy, sum(cr) AS a2, sum((ax - ox + bx - ox) * cr) AS sx, sum((ay - oy + b_y - oy) * cr) AS sy,
      sum(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))) AS perimeter
    FROM (SELECT *, (ax - ox) * (b_y - oy) - (bx - ox) * (ay - oy) AS cr FROM e JOIN o USING (zone_id)) GROUP BY 1),
  g AS ({L.unprojected_sql("SELECT *, ox + sx / (3 * a2) AS x, oy + sy / (3 * a2) AS y FROM m")})"""


@query(
    "zone_measures",
    L.layers_sql("z")
    + ZONE_MOMENTS
    + """ SELECT zone_id, round(abs(a2) / 2 / 1e6, 3) AS area_km2, round(perimeter / 1000, 4) AS perimeter_km,
      round(4 * pi() * abs(a2) / 2 / (perimeter * perimeter), 6) AS compactness,
      round(lon, 6) AS centroid_lon, round(lat, 6) AS centroid_lat FROM g""",
)
def zone_measures(spark: SparkSession, d: str) -> DataFrame:
    m = audit.zone_measures(L.zones(spark, d, lonlat=True))
    return m.select(
        "zone_id",
        F.round(F.col("area_m2") / 1e6, 3).alias("area_km2"),
        F.round(F.col("perimeter_m") / 1000, 4).alias("perimeter_km"),
        *[F.round(c, 6).alias(c) for c in ("compactness", "centroid_lon", "centroid_lat")],
    )


@query(
    "representative_points",
    L.layers_sql("z")
    + ZONE_MOMENTS
    + """ SELECT zone_id, round(CASE WHEN region = 'ASIA' THEN lat ELSE 30.0::DOUBLE + (y0 + 9) / 10 END, 6) AS lat,
      round(CASE WHEN region = 'ASIA' THEN lon ELSE -120.0::DOUBLE + (x0 + 11) / 4 END, 6) AS lon,
      CASE WHEN region = 'ASIA' THEN 'geometric_centroid' ELSE 'given_point' END AS source FROM g JOIN z USING (zone_id)""",
)
def representative_points(spark: SparkSession, d: str) -> DataFrame:
    key, known = F.col("n_nationkey"), F.col("region") != "ASIA"
    x, y = (key % 5) * L.SIDE + 11, F.floor(key / 5) * L.SIDE + 9
    zones = L.zones(spark, d, lonlat=True).withColumns(
        {"INTPTLON": F.when(known, L.LON0 + x / L.LON_STEP), "INTPTLAT": F.when(known, L.LAT0 + y / L.LAT_STEP)}
    )
    points = audit.representative_points(zones, lat="INTPTLAT", lon="INTPTLON")
    return points.select("zone_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "source")


FOOTPRINT_CORNERS = f"""SELECT l_returnflag, id, k, -120.0::DOUBLE + (CASE WHEN k IN (0, 3) THEN bx1 ELSE bx2 END + {L.OFF_RASTER}) / 4 AS lon,
    30.0::DOUBLE + (CASE WHEN k IN (0, 1) THEN by1 ELSE by2 END + {L.OFF_RASTER}) / 10 AS lat
  FROM (SELECT *, row_number() OVER () AS id FROM b), (VALUES (0), (1), (2), (3)) o(k)"""


@query(
    "building_measures",
    L.layers_sql("b")
    + f""", q AS ({L.projected_sql(FOOTPRINT_CORNERS)}),
      e AS (SELECT q.*, o.x AS ox, o.y AS oy, n.x AS nx, n.y AS ny FROM q JOIN q o ON q.id = o.id AND o.k = 0 JOIN q n ON q.id = n.id AND n.k = (q.k + 1) % 4),
      m AS (SELECT id, any_value(l_returnflag) AS l_returnflag, any_value(ox) AS ox, any_value(oy) AS oy, sum(cr) AS a2,
          sum((x - ox + nx - ox) * cr) AS sx, sum((y - oy + ny - oy) * cr) AS sy, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS per
        FROM (SELECT *, (x - ox) * (ny - oy) - (nx - ox) * (y - oy) AS cr FROM e) GROUP BY id),
      g AS ({L.unprojected_sql("SELECT l_returnflag, a2, per, ox + sx / (3 * a2) AS x, oy + sy / (3 * a2) AS y FROM m")})
      SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(abs(a2)) / 2 / 1e6, 2) AS area_km2, round(avg(per), 2) AS mean_perimeter_m,
        round(avg(4 * pi() * abs(a2) / 2 / (per * per)), 7) AS mean_compactness, round(avg(lon), 7) AS mean_lon, round(avg(lat), 7) AS mean_lat
      FROM g GROUP BY ALL""",
)
def building_measures(spark: SparkSession, d: str) -> DataFrame:
    b = L.footprints(spark, d, lonlat=True)
    m = b.select("l_returnflag", shapes.measures("geom", "equal_area", centre_lonlat=True).alias("m"))
    return m.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("m.area") / 1e6, 2).alias("area_km2"),
        F.round(F.avg("m.length"), 2).alias("mean_perimeter_m"),
        F.round(F.avg(shapes.compactness("m.area", "m.length")), 7).alias("mean_compactness"),
        F.round(F.avg("m.cx"), 7).alias("mean_lon"),
        F.round(F.avg("m.cy"), 7).alias("mean_lat"),
    )


ROAD_ENDS = """SELECT o_orderkey, k, -120.0::DOUBLE + ex / 4 AS lon, 30.0::DOUBLE + ey / 10 AS lat FROM (
  SELECT o_orderkey, 0 AS k, px AS ex, py AS ey FROM r UNION ALL SELECT o_orderkey, 1, qx, qy FROM r)"""


@query(
    "zone_density",
    L.layers_sql("z p r lb")
    + f"""{ZONE_MOMENTS}, w AS ({L.projected_sql(ROAD_ENDS)}),
      len AS (SELECT a.o_orderkey, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS m
        FROM w a JOIN w b ON a.o_orderkey = b.o_orderkey AND a.k = 0 AND b.k = 1),
      t AS (SELECT zone_id, sum(m) AS m FROM lb JOIN len USING (o_orderkey) WHERE t1 >= t0 GROUP BY 1),
      q AS (SELECT m.zone_id, coalesce(t.m, 0) / 1000 / (abs(a2) / 2 / 1e6) AS density FROM m LEFT JOIN t USING (zone_id))
      SELECT count(*)::BIGINT AS n, round(avg(density), 6) AS mean, round(quantile_cont(density, 0.02), 6) AS p02,
        round(quantile_cont(density, 0.5), 6) AS p50, round(quantile_cont(density, 0.98), 6) AS p98 FROM q""",
)
def zone_density(spark: SparkSession, d: str) -> DataFrame:
    per_zone = sj.touched_length(L.roads(spark, d), L.zone_index(spark, d), L.PLACE_ID, F.col("metres"))
    values = settle(audit.density(per_zone, audit.zone_measures(L.zones(spark, d, lonlat=True))))
    bounds = exact_quantiles(values, "density", {"p02": 0.02, "p50": 0.5, "p98": 0.98})
    mean = values.agg(F.round(F.avg("density"), 6)).scalar()
    n = values.agg(F.count("density")).scalar()
    return bounds.select(n.alias("n"), mean.alias("mean"), *[F.round(c, 6).alias(c) for c in ("p02", "p50", "p98")])


# Both ends of each clipped segment in degrees, and what it belongs to.
CLIPPED_ENDS = """SELECT -120.0::DOUBLE + (px + t0 * dx) / 4 AS lon1, 30.0::DOUBLE + (py + t0 * dy) / 10 AS lat1,
    -120.0::DOUBLE + (px + t1 * dx) / 4 AS lon2, 30.0::DOUBLE + (py + t1 * dy) / 10 AS lat2,
    {'zone': zone_id, 'road': o_orderkey, 'status': o_orderstatus} AS rest
  FROM lb WHERE t1 - t0 > 1e-12 AND o_orderstatus IN ('F', 'O')"""
BOTH_LENGTHS = f""", ends AS ({CLIPPED_ENDS}), e AS (SELECT rest, metres AS ellipsoid FROM ({L.geodesic_sql("SELECT * FROM ends")})),
  w1 AS ({L.projected_sql("SELECT rest, lon1 AS lon, lat1 AS lat FROM ends")}), w2 AS ({L.projected_sql("SELECT rest, lon2 AS lon, lat2 AS lat FROM ends")}),
  both_ways AS (SELECT rest.zone AS zone_id, rest.status AS status, ellipsoid, sqrt((w1.x - w2.x) * (w1.x - w2.x) + (w1.y - w2.y) * (w1.y - w2.y)) AS flat
    FROM w1 JOIN w2 USING (rest) JOIN e USING (rest))"""


@query(
    "length_precision",
    L.layers_sql("z p r lb")
    + f"""{BOTH_LENGTHS}, g AS (SELECT zone_id, greatest(0, 1 - least(1, sum(flat) FILTER (status = 'F') / sum(flat) FILTER (status = 'O'))) AS a,
        greatest(0, 1 - least(1, sum(ellipsoid) FILTER (status = 'F') / sum(ellipsoid) FILTER (status = 'O'))) AS b
      FROM both_ways GROUP BY 1 HAVING count(*) FILTER (status = 'F') > 0 AND count(*) FILTER (status = 'O') > 0),
      k AS (SELECT *, abs(a - b) AS diff, abs(rank() OVER (ORDER BY a) + count(*) OVER (PARTITION BY a) / 2.0 - rank() OVER (ORDER BY b) - count(*) OVER (PARTITION BY b) / 2.0)::DOUBLE AS shift FROM g),
      d AS (SELECT 100.0::DOUBLE * abs(flat / ellipsoid - 1) AS pct FROM both_ways WHERE ellipsoid >= 100)
    SELECT count(*)::BIGINT AS n_zones, round(avg(diff), 9) AS mean_abs_difference, round(median(diff), 9) AS median_abs_difference, round(max(diff), 9) AS max_abs_difference, arg_max(zone_id, diff) AS max_at,
      count(*) FILTER (diff > 0.001)::BIGINT AS n_above_0_001, count(*) FILTER (diff > 0.01)::BIGINT AS n_above_0_01, round(avg(shift), 6) AS mean_rank_shift, max(shift) AS max_rank_shift,
      (SELECT count(*)::BIGINT FROM d) AS n_segments, (SELECT round(avg(pct), 6) FROM d) AS mean_pct, (SELECT round(median(pct), 6) FROM d) AS median_pct, (SELECT round(max(pct), 4) FROM d) AS max_pct FROM k""",
)
def length_precision(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("o_orderstatus") == "F", "observed").when(F.col("o_orderstatus") == "O", "reference")
    roads = L.roads(spark, d, lonlat=True).withColumn("side", side).filter("side is not null")
    measured = settle(audit.clipped_both_ways(roads, L.zone_index(spark, d, lonlat=True), L.PLACE_ID, "side"))
    found = audit.precision_summary(audit.length_precision(measured, "side"))
    segments = audit.segment_distortion(measured)
    digits = {"mean_abs_difference": 9, "median_abs_difference": 9, "max_abs_difference": 9, "mean_rank_shift": 6, "mean_pct": 6, "median_pct": 6, "max_pct": 4}
    row = found.withColumns({c: segments.select(c).scalar() for c in segments.columns})
    return row.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "wkb_ingest",
    L.layers_sql("z b")
    + f""" SELECT zone_id, count(*)::BIGINT AS n, round(sum((bx2 - bx1) * (by2 - by1)), 4) AS area
      FROM z JOIN b ON {BOX_MEETS} GROUP BY ALL""",
)
def wkb_ingest(spark: SparkSession, d: str) -> DataFrame:
    stored = L.footprints(spark, d).select(*L.FOOTPRINT_ID, geo.encode_wkb("geom").alias("geometry"))
    decoded = geo.decode_geometry(stored).withColumn("area", shapes.measures("geom")["area"])
    pairs = sj.assign_by_intersection(decoded, L.zone_index(spark, d), L.FOOTPRINT_ID, keep=["area"])
    return pairs.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"))


@query(
    "coordinate_guard",
    L.layers_sql("b")
    + """, c AS (SELECT bx1 * 4 - 150 AS x1, bx2 * 4 - 150 AS x2, by1 AS y1, by2 AS y2 FROM b)
      SELECT count(*)::BIGINT AS n_geometries,
        count(*) FILTER (NOT (x1 >= -180 AND x2 <= 180 AND y1 >= -90 AND y2 <= 90))::BIGINT AS out_of_range,
        count(*) FILTER (NOT (x1 >= -180 AND x2 <= 180 AND y1 >= -90 AND y2 <= 90)
          AND y1 >= -180 AND y2 <= 180 AND x1 >= -90 AND x2 <= 90)::BIGINT AS swapped_axes FROM c""",
)
def coordinate_guard(spark: SparkSession, d: str) -> DataFrame:
    b = L.footprints(spark, d)
    moved = b.select(
        (F.col("xmin") * 4 - 150).alias("xmin"), (F.col("xmax") * 4 - 150).alias("xmax"), "ymin", "ymax"
    )
    return geo.coordinate_report(moved)


# Shapes with known defects: a bow-tie for one line number, no geometry for another.
AUDITED = """
g AS (SELECT *, l_linenumber = 3 AS tie, l_linenumber = 5 AS gone FROM b)"""


@query(
    "layer_audit",
    L.layers_sql("b")
    + f""", {AUDITED} SELECT l_returnflag AS region, 'buildings' AS layer, 'ok' AS status, count(*)::BIGINT AS row_count,
        count(*) FILTER (gone)::BIGINT AS null_geometry_count, count(*) FILTER (tie)::BIGINT AS invalid_geometry_count,
        0::BIGINT AS empty_geometry_count, round(1e6::DOUBLE * count(*) FILTER (tie) / count(*), 4) AS invalid_per_million,
        '{{"POLYGON":' || count(*) FILTER (NOT gone) || '}}' AS geometry_type_counts,
        (count(*) - count(DISTINCT l_orderkey))::BIGINT AS duplicate_count
      FROM g GROUP BY ALL""",
)
def layer_audit(spark: SparkSession, d: str) -> DataFrame:
    b = L.footprints(spark, d)
    x1, y1, x2, y2 = (F.col(c) for c in shapes.BOUNDS)
    tie = shapes.polygon_geom([(x1, y1), (x2, y2), (x2, y1), (x1, y2)])
    geom = F.when(F.col("l_linenumber") == 3, tie).when(F.col("l_linenumber") != 5, F.col("geom"))
    damaged = b.select("l_orderkey", "l_returnflag", "l_quantity", geom.alias("geom"))
    found = audit.layer_audit(damaged, F.col("l_returnflag"), "buildings", columns=["l_quantity"])
    keys = damaged.select(F.col("l_returnflag").alias("region"), F.col("l_orderkey").alias("key"))
    report = audit.audit_layers({"buildings": found}, {"buildings": keys})
    return report.drop("null_pct_by_column").withColumn("invalid_per_million", F.round("invalid_per_million", 4))


def _raw_layers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Layers as they are stored, with geometry as WKB, some rows against their contract."""
    point = geo.encode_wkb(shapes.point_geom("x", "y")).alias("geometry")
    key = F.col("o_orderkey")
    places = L.places(spark, d, lonlat=True)
    return {
        "observed-places": places.select(
            F.struct(F.col("o_orderpriority").alias("primary")).alias("categories"), (F.col("o_totalprice") / 400000).alias("confidence"), point
        ),
        "reference-roads": L.roads(spark, d, lonlat=True).select(
            F.when(key % 50 != 0, key.cast("string")).alias("LINEARID"), F.col("o_orderstatus").alias("FULLNAME"), F.lit("M").alias("RTTYP"),
            F.col("o_orderpriority").alias("MTFCC"), geo.encode_wkb("geom").alias("geometry"),
        ),
        "reference-establishments": L.table(spark, d, "customer").select(
            F.col("c_custkey").cast("string").alias("GEOID"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("STATEFP"), F.lit("013").alias("COUNTYFP"),
            F.when(F.col("c_mktsegment") != "BUILDING", "000100").alias("TRACTCE"), F.col("c_acctbal").alias("cbp_estab"), F.lit(0).alias("cbp_estab_res"),
            F.lit(None).cast("int").alias("cbp_estab_bus"), F.lit(None).cast("binary").alias("geometry"),
        ),
    }


@query(
    "layer_contracts",
    """SELECT 'observed-places' AS layer, 'confidence' AS column_name, 'in [0, 1]' AS check_name, count(*) FILTER (NOT o_totalprice / 400000 BETWEEN 0 AND 1)::BIGINT AS violations FROM orders
    UNION ALL SELECT 'reference-roads', 'LINEARID', 'not null', count(*) FILTER (o_orderkey % 50 = 0)::BIGINT FROM orders
    UNION ALL SELECT 'reference-roads', 'MTFCC', 'not null', count(*) FILTER (o_orderpriority IS NULL)::BIGINT FROM orders
    UNION ALL SELECT 'reference-roads', 'MTFCC', 'length 5', count(*) FILTER (length(o_orderpriority) <> 5)::BIGINT FROM orders
    UNION ALL SELECT 'reference-establishments', 'GEOID', 'not null', 0::BIGINT
    UNION ALL SELECT 'reference-establishments', 'GEOID', '11 digits', count(*) FILTER (length(c_custkey::VARCHAR) <> 11)::BIGINT FROM customer
    UNION ALL SELECT 'reference-establishments', 'STATEFP', 'not null', 0::BIGINT
    UNION ALL SELECT 'reference-establishments', 'STATEFP', '2 digits', count(*) FILTER (c_nationkey > 99)::BIGINT FROM customer
    UNION ALL SELECT 'reference-establishments', 'COUNTYFP', 'not null', 0::BIGINT
    UNION ALL SELECT 'reference-establishments', 'COUNTYFP', '3 digits', 0::BIGINT
    UNION ALL SELECT 'reference-establishments', 'TRACTCE', 'not null', count(*) FILTER (c_mktsegment = 'BUILDING')::BIGINT FROM customer
    UNION ALL SELECT 'reference-establishments', 'TRACTCE', '6 digits', 0::BIGINT
    UNION ALL SELECT 'reference-establishments', 'cbp_estab', '>= 0', count(*) FILTER (c_acctbal < 0)::BIGINT FROM customer
    UNION ALL SELECT 'reference-establishments', 'cbp_estab_res', '>= 0', 0::BIGINT
    UNION ALL SELECT 'reference-establishments', 'cbp_estab_bus', '>= 0', 0::BIGINT""",
)
def layer_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Every check of three layers' contracts, with its violations."""
    reports = [
        contract_report(layer, LAYER_CONTRACTS[name]).withColumn("layer", F.lit(name)) for name, layer in _raw_layers(spark, d).items()
    ]
    return union_scopes(reports).select("layer", "column_name", "check_name", "violations")


AUDIT_REGIONS = ("R0", "R1", "R2", "R3", "R4")
_FAILED_SQL = "SELECT 'R' || unnest(range(5)), '{}', '{}', '{}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"


@query(
    "audit_report",
    """WITH e AS (SELECT 'R' || unnest(range(5)) AS region),
      p AS (SELECT 'R' || o_orderkey % 4 AS region, o_orderkey % 7 = 0 AS gone, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice / 400000 ELSE o_totalprice / 1e6::DOUBLE END AS confidence FROM orders),
      bad AS (SELECT region, count(*) AS n, string_agg(v, ', ' ORDER BY v) FILTER (place <= 10) AS shown FROM (
        SELECT region, confidence::VARCHAR AS v, row_number() OVER (PARTITION BY region ORDER BY confidence::VARCHAR) AS place FROM p WHERE NOT confidence BETWEEN 0 AND 1) GROUP BY 1),
      ps AS (SELECT region, count(*) AS n, count(*) FILTER (gone) AS gone FROM p GROUP BY 1),
      c AS (SELECT 'R' || c_custkey % 4 AS region, count(*) AS n, count(*) - count(DISTINCT c_custkey // 8) AS repeated, count(*) FILTER (c_mktsegment = 'BUILDING') AS unknown FROM customer GROUP BY 1)
    SELECT region, 'observed-places' AS layer, CASE WHEN ps.n IS NULL THEN 'missing_file' WHEN bad.n IS NOT NULL THEN 'schema_violation' ELSE 'ok' END AS status,
      CASE WHEN ps.n IS NULL THEN 'no rows' WHEN bad.n IS NOT NULL THEN 'confidence: ' || bad.n || ' rows fail ''in [0, 1]'', e.g. ' || shown END AS error_message,
      CASE WHEN bad.n IS NULL THEN ps.n END::BIGINT AS row_count, CASE WHEN bad.n IS NULL THEN gone END::BIGINT AS null_geometry_count,
      CASE WHEN bad.n IS NULL AND ps.n IS NOT NULL THEN 0 END::BIGINT AS invalid_geometry_count, CASE WHEN bad.n IS NULL AND ps.n IS NOT NULL THEN 0 END::BIGINT AS empty_geometry_count,
      CASE WHEN bad.n IS NULL AND ps.n IS NOT NULL THEN 0 END::DOUBLE AS invalid_per_million, CASE WHEN bad.n IS NULL THEN '{"POINT":' || (ps.n - gone) || '}' END AS geometry_type_counts,
      CASE WHEN bad.n IS NULL THEN '{"categories":0.0,"confidence":0.0,"geometry":' || round(gone / ps.n, 4) || '}' END AS null_pct_by_column,
      NULL::BIGINT AS duplicate_count, NULL::BIGINT AS expected_row_count, NULL::BOOLEAN AS row_count_matches_expected
    FROM e LEFT JOIN ps USING (region) LEFT JOIN bad USING (region)
    UNION ALL SELECT region, 'reference-establishments', CASE WHEN c.n IS NULL THEN 'missing_file' ELSE 'ok' END, CASE WHEN c.n IS NULL THEN 'no rows' END, c.n, c.n, c.n * 0, c.n * 0, c.n * 0, CASE WHEN c.n IS NOT NULL THEN '{}' END,
      '{"GEOID":0.0,"STATEFP":0.0,"COUNTYFP":0.0,"TRACTCE":0.0,"cbp_estab":0.0,"cbp_estab_res":' || round(unknown / c.n, 4) || ',"cbp_estab_bus":1.0,"geometry":1.0}', repeated,
      CASE WHEN c.n IS NOT NULL THEN (SELECT count(*) FROM supplier) END, CASE WHEN c.n IS NOT NULL THEN c.n = (SELECT count(*) FROM supplier) END
    FROM e LEFT JOIN c USING (region)
    UNION ALL """
    + " UNION ALL ".join(
        _FAILED_SQL.format(*failed)
        for failed in (
            ("reference-roads", "schema_violation", "MTFCC: column missing"),
            ("reference-schools", "missing_file", "no such table"),
            ("strata/lakes", "not_implemented", "no contract for strata/lakes"),
        )
    ),
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """Five layers of five regions: sound, against their contract, lacking a column, absent,
    unknown; one region has no rows."""
    raw = _raw_layers(spark, d)
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    point = geo.encode_wkb(F.when(key % 7 != 0, shapes.point_geom("x", "y"))).alias("geometry")
    places = L.places(spark, d, lonlat=True).select(
        F.concat(F.lit("R"), key % 4).alias("region"), F.struct(F.col("o_orderpriority").alias("primary")).alias("categories"),
        F.when(key % 4 == 1, price / 400000).otherwise(price / 1e6).alias("confidence"), point,
    )
    customer = F.col("c_custkey")
    establishments = L.table(spark, d, "customer").select(
        F.concat(F.lit("R"), customer % 4).alias("region"), F.lpad(F.floor(customer / 8).cast("string"), 11, "0").alias("GEOID"), F.lit("04").alias("STATEFP"),
        F.lit("013").alias("COUNTYFP"), F.lit("000100").alias("TRACTCE"), customer.alias("cbp_estab"), F.when(F.col("c_mktsegment") != "BUILDING", customer).alias("cbp_estab_res"),
        F.lit(None).cast("int").alias("cbp_estab_bus"), F.lit(None).cast("binary").alias("geometry"),
    )
    loaders = {
        "observed-places": lambda: places,
        "reference-establishments": lambda: establishments,
        "reference-roads": lambda: raw["reference-roads"].drop("MTFCC").withColumn("region", F.lit("R0")),
        "reference-schools": lambda: geo.read_flat(spark, f"{d}/absent.parquet"),
        "strata/lakes": lambda: places,
    }
    suppliers = L.table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("expected_row_count"))
    wanted = suppliers.select(F.explode(F.array(*[F.lit(r) for r in AUDIT_REGIONS])).alias("region"), "expected_row_count")
    found = audit.audit_regions(spark, loaders, LAYER_CONTRACTS, AUDIT_REGIONS, expected={"reference-establishments": wanted})
    # The message names the path, shares have many digits.
    shares = F.transform_values(F.from_json("null_pct_by_column", "map<string,double>"), lambda _, share: F.round(share, 4))
    return found.withColumns({"error_message": F.regexp_replace("error_message", r": \[.*absent.*", ""), "null_pct_by_column": F.to_json(shares)})


@query(
    "layer_load",
    L.layers_sql("p")
    + """ SELECT o_orderpriority, count(*)::BIGINT AS n, round(min(-120.0::DOUBLE + px / 4), 6) AS west, round(max(30.0::DOUBLE + py / 10), 6) AS north FROM p
      WHERE o_totalprice BETWEEN 0 AND 400000 GROUP BY ALL""",
)
def layer_load(spark: SparkSession, d: str) -> DataFrame:
    """A stored layer through contract, decoding and coordinate guard."""
    sound = _raw_layers(spark, d)["observed-places"].filter("confidence BETWEEN 0 AND 1")
    loaded = geo.checked_layer(sound, "observed-places")
    return loaded.groupBy(F.col("categories.primary").alias("o_orderpriority")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("xmin"), 6).alias("west"), F.round(F.max("ymax"), 6).alias("north")
    )


@query(
    "strata_loaded",
    L.layers_sql("z")
    + """ SELECT zone_id AS "GEOID", region, round(-120.0::DOUBLE + x0 / 4, 6) AS west, round(30.0::DOUBLE + y0 / 10, 6) AS south FROM z
      UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 11, '0'), NULL, NULL, NULL FROM supplier""",
)
def strata_loaded(spark: SparkSession, d: str) -> DataFrame:
    """A strata table with geometry and one without, each stored and loaded through its guards."""
    folder = shared_folder(spark, "strata")
    L.zones(spark, d, lonlat=True).select(F.col("zone_id").alias("GEOID"), "region", geo.encode_wkb("geom").alias("geometry")).write.parquet(f"{folder}/geo")
    L.table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 11, "0").alias("GEOID"), "s_acctbal").write.parquet(f"{folder}/flat")
    tracts = geo.require_kind(geo.load_strata_geo(spark, f"{folder}/geo"), (shapes.POLYGON,))
    flat = geo.load_strata_flat(spark, f"{folder}/flat")
    places = tracts.select("GEOID", "region", F.round("xmin", 6).alias("west"), F.round("ymin", 6).alias("south"))
    return union_scopes([places, flat.select("GEOID")])


@query(
    "region_partitions",
    """SELECT r_name AS region, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS balance
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY ALL""",
)
def region_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A table written by region and some of its regions read back: the others are not listed."""
    folder = shared_folder(spark, "regions")
    nations = L.table(spark, d, "nation").join(L.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = L.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    tables.write_regions(customers.select("c_custkey", "c_acctbal", F.col("r_name").alias("region")), folder)
    some = geo.read_regions(spark, folder, ["ASIA", "EUROPE"])
    return some.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    "manifest_from_csv",
    """SELECT lpad(CAST(n_nationkey AS VARCHAR), 11, '0') AS "GEOID", r_name AS region, CAST(n_nationkey AS DOUBLE) AS code, CAST(NULL AS DOUBLE) AS name
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def manifest_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """A key list through CSV: keys keep their zeros, other columns are numbers or nothing."""
    folder = shared_folder(spark, "manifest")
    nations = L.table(spark, d, "nation").join(L.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.select(F.lpad(F.col("n_nationkey").cast("string"), 11, "0").alias("GEOID"), F.col("r_name").alias("region"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    tables.write_csv(rows, folder)
    return tables.load_manifest(spark, folder)


@query(
    "crosswalk_from_csv",
    """SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county_fips, CAST(n_nationkey AS INTEGER) AS "CODE2013",
      CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS INTEGER) END AS "CODE2023" FROM nation""",
)
def crosswalk_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """County codes through CSV, their keys put together from numbers without zeros."""
    folder = shared_folder(spark, "crosswalk")
    code = F.col("n_nationkey")
    rows = L.table(spark, d, "nation").select(
        F.col("n_regionkey").alias("STFIPS"), code.alias("CTYFIPS"), code.cast("double").alias("CODE2013"), F.when(code % 2 == 0, code.cast("string")).otherwise("none").alias("CODE2023")
    )
    tables.write_csv(rows, folder)
    return tables.load_crosswalk(spark, folder).select("county_fips", "CODE2013", "CODE2023")
