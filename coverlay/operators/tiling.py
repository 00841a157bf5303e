"""Zones cut into grid tiles: the small side of every spatial join.

A tile is one (cell, zone) pair that can hold a match.

* ``core`` tiles lie in the zone's open interior, so anything in the cell is inside and no
  geometry is tested.
* the others carry only the zone's edges needed to decide a point *in that cell*: edges in
  the cell's row that are not wholly to its left.  Edges far to the right that span the
  whole row are crossed by every point of the cell and shrink to one parity bit.

So the exact test costs a few edges per candidate however large the zone is, and a zone
polygon never travels with the features.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from coverlay.functions import covers, kernels, shapes, types

TILE_FIELDS = ("cx", "cy", "core", "parity", "edges")
# Cells per median zone side; finer grids mean more core cells but more tiles.
SPLITS = (8, 4, 2)
# Largest tile table that is sent to every executor; beyond it both sides are shuffled.
BROADCAST_BYTES = 128 * 1024 * 1024
# Zones whose sides differ by less than this factor share a grid.
CLASS_FACTOR = 4.0
# Share of a cell by which tests are widened, so rounding never hides a neighbour.
MARGIN = 1e-9
# Levels of coarser cells above a grid's own, each twice as wide: what a large feature fills.
LEVELS = 8
# Tiles that one row of a window's table holds; more zones continue in further rows.
WINDOW_TILES = 16
# Zone vertices tiled by one task before the zones are spread over more tasks.
VERTICES_PER_TASK = 500_000


@dataclass(frozen=True)
class Grid:
    """Square cells for one size class of zones; ``tile_bytes`` bounds their tile table.

    ``size_class`` is the class of the zones on this grid, None for all zones; ``nested_bytes``
    bounds the tile table with its coarser levels.
    """

    size: float
    tile_bytes: int
    vertices: int = 0
    size_class: int | None = None
    nested_bytes: int = 0

    @property
    def margin(self) -> float:
        return self.size * MARGIN

    @property
    def can_broadcast(self) -> bool:
        return self.tile_bytes <= BROADCAST_BYTES

    @property
    def can_broadcast_windows(self) -> bool:
        """A tile is in four windows and in its cell's own row."""
        return 5 * self.tile_bytes <= BROADCAST_BYTES

    @property
    def can_broadcast_nested(self) -> bool:
        return max(self.nested_bytes, self.tile_bytes) <= BROADCAST_BYTES

    def cell(self, coordinate: Column) -> Column:
        """NULL for coordinates that are NaN, infinite or beyond every possible tile."""
        return F.when(F.abs(coordinate) < F.lit(2.0**31 * self.size), F.floor(coordinate / F.lit(self.size)).cast("int"))


def _side_class(measures: str) -> Column:
    """Number of the zone's size class; zones without extent go to the class of side 1."""
    side = F.greatest(F.col(f"{measures}.xmax") - F.col(f"{measures}.xmin"), F.col(f"{measures}.ymax") - F.col(f"{measures}.ymin"))
    return F.floor(F.log(F.when(side > 0, side).otherwise(1.0)) / math.log(CLASS_FACTOR)).cast("int")


def choose_grids(zones: DataFrame, geom: str = "geom") -> list[Grid]:
    """Measure the zones (one aggregate, one row back per size class) and size a grid for each
    class of zones of about one size.

    A few large zones among many small ones so get a coarse grid of their own, and no zone
    more tiles than a multiple of its border.  The bound counts every tile and edge copy that
    a split can create, so whether the tile tables may be broadcast is decided on measured
    numbers; the finest split within the bound is taken, else the coarsest.
    """
    m = zones.select(shapes.measures(geom).alias("m")).filter(F.col("m.xmin").isNotNull()).select(
        _side_class("m").alias("size_class"),
        (F.col("m.xmax") - F.col("m.xmin")).alias("w"),
        (F.col("m.ymax") - F.col("m.ymin")).alias("h"),
        F.col("m.n_points").alias("n"),
        F.col("m.length").alias("climb"),
    )
    classes = m.groupBy("size_class").agg(
        F.percentile_approx(F.greatest("w", "h"), 0.5, 1000).alias("side"),
        F.count("w").alias("zones"),
        F.sum("n").alias("n"),
        F.sum("climb").alias("climb"),
        F.sum(F.col("n") * F.col("w")).alias("n_w"),
        F.sum(F.col("climb") * F.col("w")).alias("climb_w"),
        F.sum(F.col("w") * F.col("h")).alias("area"),
        F.sum(F.col("w") + F.col("h")).alias("sides"),
    )
    found = sorted((r.asDict() for r in classes.collect()), key=lambda r: r["size_class"])
    if not found:
        return [Grid(1.0, 0)]
    tried = [[_bounded_grid(r, (float(r["side"] or 0.0) or 1.0) / split) for r in found] for split in SPLITS]
    return next((g for g in tried if sum(x.tile_bytes for x in g) <= BROADCAST_BYTES), tried[-1])


def _bounded_grid(total: dict, size: float) -> Grid:
    """Upper bound on tile rows and on edge copies (rows an edge spans x columns of its zone).

    Total edge length stands in for total height, which it is never below.
    """
    t = {k: float(v or 0.0) for k, v in total.items() if k != "size_class"}
    tiles = t["area"] / size**2 + 2 * t["sides"] / size + 4 * t["zones"]
    copies = 2 * t["n_w"] / size + 4 * t["n"] + t["climb_w"] / size**2 + 2 * t["climb"] / size
    own = math.ceil(tiles * 96 + copies * 32)
    # A level has a quarter of the cells of the one below, and up to four cells for any zone.
    coarser = math.ceil((tiles / 3 + 4 * LEVELS * t["zones"]) * 96)
    return Grid(size, own, int(t["n"]), total["size_class"], own + coarser)


def build_tiles(zones: DataFrame, grid: Grid, zone_id: str = "zone_id", geom: str = "geom") -> DataFrame:
    """Tile table ``cx, cy, zone_id, core, parity, edges``; work grows with zone vertices only."""
    size, margin = grid.size, grid.margin
    return _tiled(zones, grid, zone_id, geom, types.TILES, lambda shape: kernels.tiles_of(shape, size, margin))


def by_window(tiles: DataFrame, grid: Grid) -> DataFrame:
    """The tiles of all zones by cell (``reach`` 1) and by window of 2 x 2 cells (``reach`` 2).

    ``wx, wy`` is the window's first cell, ``zones`` the zones found there in ascending order and
    ``tiles`` their tiles, with ``z``, the zone's place in ``zones``.  A zone's tiles are in one row; ``whole``
    says that the row has all zones of the window, ``all_core`` that all its tiles are core.
    Windows are left out where the table would be too large to broadcast.
    """
    corners = [(1, 0, 0), *((2, dx, dy) for dx in (0, 1) for dy in (0, 1) if grid.can_broadcast_windows)]
    spots = [F.struct(F.lit(r).alias("reach"), (F.col("cx") - dx).alias("wx"), (F.col("cy") - dy).alias("wy")) for r, dx, dy in corners]
    spot = ["reach", "wx", "wy"]
    placed = tiles.withColumn("_spot", F.explode(F.array(*spots))).select(*[f"_spot.{c}" for c in spot], "zone_id", F.struct(*TILE_FIELDS).alias("tile"))
    per_zone = placed.groupBy(*spot, "zone_id").agg(F.collect_list("tile").alias("tiles"))
    before = F.sum(F.size("tiles")).over(Window.partitionBy(*spot).orderBy("zone_id")) - F.size("tiles")
    rows = per_zone.withColumn("part", F.floor(before / WINDOW_TILES)).withColumn("parts", F.max("part").over(Window.partitionBy(*spot)))
    found = rows.groupBy(*spot, "part", "parts").agg(F.array_sort(F.collect_list(F.struct("zone_id", "tiles"))).alias("found"))
    numbered = F.flatten(
        F.transform("found", lambda e, z: F.transform(e["tiles"], lambda t: F.struct(z.alias("z"), *[t[c].alias(c) for c in TILE_FIELDS])))
    )
    return found.select(
        *spot, (F.col("parts") == 0).alias("whole"), F.col("found.zone_id").alias("zones"), numbered.alias("tiles")
    ).withColumn("all_core", F.forall("tiles", lambda t: t["core"]))


def build_nested_tiles(zones: DataFrame, grid: Grid, zone_id: str = "zone_id", geom: str = "geom") -> DataFrame:
    """The tiles at ``_level`` 0, and each zone's cells on the coarser levels."""
    size, margin = grid.size, grid.margin
    return _tiled(zones, grid, zone_id, geom, types.NESTED, lambda shape: covers.nested_tiles(shape, size, margin, LEVELS))


def build_near_tiles(zones: DataFrame, grid: Grid, projected: bool, zone_id: str = "zone_id", geom: str = "geom") -> DataFrame:
    """The tiles with ``near``, the edges that can be nearest to a point of the tile."""
    size, margin = grid.size, grid.margin
    return _tiled(zones, grid, zone_id, geom, types.NEAR, lambda shape: covers.near_tiles(shape, size, margin, projected))


def _tiled(zones: DataFrame, grid: Grid, zone_id: str, geom: str, kind: ArrayType, cut: Callable[[pa.Array], pa.Array]) -> DataFrame:
    @F.arrow_udf(kind)
    def tiles_of(shape: pa.Array) -> pa.Array:
        return cut(shape)

    tasks = grid.vertices // VERTICES_PER_TASK
    source = zones.select(F.col(zone_id).alias("zone_id"), F.col(geom).alias("_geom"))
    if grid.size_class is not None:
        sized = source.withColumn("_m", shapes.measures("_geom"))
        source = sized.filter(_side_class("_m") == grid.size_class).drop("_m")
    if tasks > 1:
        source = source.repartition(tasks, "zone_id")
    found = tiles_of.asNondeterministic()(F.col("_geom"))
    return source.select("zone_id", found.alias("_tiles")).select("zone_id", F.inline("_tiles"))


def join_tiles(features: DataFrame, tiles: DataFrame, grid: Grid) -> DataFrame:
    """Equi-join features (already carrying ``cx, cy``) with the tiles of their cell.

    A tile table within the measured bound is broadcast and features never move.
    """
    return join_small(features, tiles, ["cx", "cy"], grid.can_broadcast)


def join_small(large: DataFrame, small: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """Inner join with a side measured to be small, or by shuffle.

    In the shuffle a cell or zone with a third of all rows makes one large partition, which
    adaptive execution splits by its measured size, copying only that partition's few rows
    of the other side.
    """
    return large.join(F.broadcast(small) if broadcast else small, keys)
