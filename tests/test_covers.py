"""Features of any size and distances to a border, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlay.functions import geodesy, shapes
from coverlay.operators import spatial_join as sj
from coverlay.operators.tiling import BROADCAST_BYTES, Grid, build_near_tiles, choose_grids
from tests.geometry import ZONE_SCHEMA, box, multipolygon, polygon, shapes_frame
from tests.test_spatial import edges_of, irregular, locate, pairs, shapes_meet, star


@pytest.fixture(scope="module")
def world(spark):
    zones = irregular(random.Random(11))
    return zones, shapes_frame(spark, zones, ZONE_SCHEMA)


def features(rng):
    out = {}
    for i in range(60):
        x, y = rng.randint(-60, 250), rng.randint(-60, 250)
        w, h = rng.choice([(1, 1), (40, 40), (90, 60), (200, 3), (2, 150)])
        out[f"b{i}"] = box(x, y, x + w, y + h) if i % 3 else polygon(star(rng, x, y, rng.choice([9, 60, 120]), 15))
    out["all"] = box(-500, -500, 700, 700)
    out["frame"] = polygon([(-80, -80), (280, -80), (280, 280), (-80, 280)], [(-40, -40), (220, -40), (220, 220), (-40, 220)])
    out["hole"] = polygon([(-80, -80), (280, -80), (280, 280), (-80, 280)], [(-60, -60), (260, -60), (260, 260), (-60, 260)])
    out["parts"] = multipolygon([[(0, 0), (90, 0), (0, 90)]], [[(200, 200), (110, 200), (200, 110)]])
    out["same"] = box(-50, -50, 250, 250)
    return {k: v for k, v in out.items() if len(edges_of(v)) >= 3}


@pytest.mark.parametrize("large_cells, split, broadcast", [(0, 1.0, True), (16, 0.31, False)])
def test_large_polygons_equal_brute_force(spark, world, monkeypatch, large_cells, split, broadcast):
    monkeypatch.setattr(sj, "LARGE_CELLS", large_cells)
    zones, frame = world
    layer = features(random.Random(3))
    grid = choose_grids(frame)[0]
    grid = Grid(grid.size * split, grid.tile_bytes if broadcast else BROADCAST_BYTES + 1, grid.vertices)
    index = sj.ZoneIndex(frame, grids=[grid])
    table = shapes_frame(spark, layer)
    want = {(f, z) for f, a in layer.items() for z, b in zones.items() if shapes_meet(a, b)}
    assert set(pairs(sj.assign_by_intersection(table, index, ["fid"]), "fid", "zone_id")) == want
    marked = sj.polygon_pairs(table, index, ["fid"], centre="planar")
    assert set(pairs(marked.filter("touches"), "fid", "zone_id")) == want
    centred = set(pairs(sj.assign_by_centroid(table, index, centroid_space="planar"), "fid", "zone_id"))
    assert set(pairs(marked.filter("centred"), "fid", "zone_id")) == centred


def test_a_feature_over_20000_zones_costs_its_border(spark):
    """142 x 142 unit zones; the feature is a hundred-cornered disc with a square hole."""
    side, step = 142, 1.25
    at = lambda k: (k * step).cast("double")
    zones = spark.range(side * side).select(
        F.col("id").cast("string").alias("zone_id"),
        shapes.box_geom(at(F.col("id") % side), at(F.floor(F.col("id") / side)), at(F.col("id") % side) + 1, at(F.floor(F.col("id") / side)) + 1).alias("geom"),
    )
    middle, radius = side * step / 2, side * step / 2 - 0.6
    ring = [(middle + radius * math.cos(2 * math.pi * k / 100), middle + radius * math.sin(2 * math.pi * k / 100)) for k in range(100)]
    hole = [(80.0, 80.0), (95.0, 80.0), (95.0, 95.0), (80.0, 95.0)]
    shape = polygon(ring, hole)
    index = sj.ZoneIndex(zones)
    layer = sj.with_bounds(shapes_frame(spark, {"disc": shape}))
    (level,) = index.levels
    cells = sj._covering_cells(layer, level.grid, "geom", None)
    border = sum(math.hypot(a - c, b - d) for a, b, c, d in edges_of(shape)) / level.grid.size
    box_cells = (2 * radius / level.grid.size) ** 2
    n = cells.count()
    assert n < 12 * border and n < box_cells / 20
    per_cell = sj.polygon_pairs(layer, index, ["fid"])
    found = per_cell.select("zone_id").collect()
    edges = edges_of(shape)

    def meets(i):
        x, y = (i % side) * step, (i // side) * step
        corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        if any(locate(edges, *c) for c in corners):
            return True
        return shapes_meet(box(x, y, x + 1, y + 1), shape)

    want = {str(i) for i in range(side * side) if meets(i)}
    assert {r[0] for r in found} == want and len(want) > 12_000
    # The zones in its interior come a few times each, not once per cell of theirs.
    assert len(found) < 3 * len(want) + 12 * border
    assert {r["n"] for r in sj.count_pairs(per_cell, ["fid"]).select("n").collect()} == {1}


# --- distances ------------------------------------------------------------------------------


def nearest(edges, x, y):
    best = math.inf
    for ax, ay, bx, by in edges:
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


@pytest.mark.parametrize("broadcast", [True, False])
def test_distances_equal_brute_force(spark, world, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(sj, "BROADCAST_BYTES", 0)
    zones, frame = world
    rng = random.Random(8)
    pts = [(i, rng.randint(-60, 260) + rng.choice([0.0, 0.5]), float(rng.randint(-60, 260))) for i in range(1500)] + [(9999, None, 3.0), (9998, math.nan, 3.0)]
    got = sj.distance_to_boundary(spark.createDataFrame(pts, "fid int, x double, y double"), frame, projected=False)
    assert got.columns == ["fid", "x", "y", "zone_id", "boundary_distance"]
    got = {(r["fid"], r["zone_id"]): r["boundary_distance"] for r in got.collect()}
    want = {}
    for name, geom in zones.items():
        edges = edges_of(geom)
        for i, x, y in pts[:-2]:
            if locate(edges, x, y) == 1:
                want[(i, name)] = nearest(edges, x, y)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())


def test_projected_distances_equal_brute_force(spark):
    """Zones from a few hundred metres to a quarter of a continent, in degrees."""
    rng = random.Random(2)
    zones = {}
    for i, radius in enumerate([0.005, 0.1, 2.0, 14.0]):
        cx, cy = -110.0 + 12 * i, 28.0 + 5 * i
        zones[f"z{i}"] = polygon([(cx + radius * rng.uniform(0.5, 1) * math.cos(a), cy + radius * rng.uniform(0.5, 1) * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 40, endpoint=False)])
    pts = []
    for i, radius in enumerate([0.005, 0.1, 2.0, 14.0]):
        pts += [(100 * i + k, -110.0 + 12 * i + rng.uniform(-radius, radius), 28.0 + 5 * i + rng.uniform(-radius, radius)) for k in range(100)]
    got = {
        (r["fid"], r["zone_id"]): r["boundary_distance"]
        for r in sj.distance_to_boundary(spark.createDataFrame(pts, "fid int, x double, y double"), shapes_frame(spark, zones, ZONE_SCHEMA)).collect()
    }
    want = {}
    for name, geom in zones.items():
        edges = edges_of(geom)
        flat = [(*geodesy.project(np, a, b), *geodesy.project(np, c, d)) for a, b, c, d in edges]
        for i, x, y in pts:
            if locate(edges, x, y) == 1:
                want[(i, name)] = nearest(flat, *geodesy.project(np, x, y))
    assert len(want) > 150 and set(got) == set(want)
    assert all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_tiles_carry_few_of_many_edges(spark):
    ring = [(10 + 9 * math.cos(2 * math.pi * k / 3000), 10 + 9 * math.sin(2 * math.pi * k / 3000)) for k in range(3000)]
    zones = shapes_frame(spark, {"disc": polygon(ring)}, ZONE_SCHEMA)
    tiles = build_near_tiles(zones, choose_grids(zones)[0], False)
    edges = [r[0] / 32 for r in tiles.select(F.octet_length("near")).collect()]
    # The middle is as far from all edges; elsewhere a part of the circle is nearest.
    assert max(edges) <= 3000 and sorted(edges)[len(edges) // 2] < 1000 and min(edges) > 0
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, 2.0, 10.0), (3, 13.0, 14.0)], "fid int, x double, y double")
    got = dict(pairs(sj.distance_to_boundary(pts, zones, projected=False), "fid", "boundary_distance"))
    assert got == {1: pytest.approx(9, abs=1e-4), 2: pytest.approx(1, abs=1e-4), 3: pytest.approx(4, abs=1e-4)}
