"""Spatial joins: golden cases and comparison with brute force on irregular zones."""

import random

import pytest
from pyspark.sql import functions as F

from coverlay.operators import spatial_join as sj
from coverlay.operators.tiling import BROADCAST_BYTES, Grid, choose_grids
from coverlay.plans import audit
from tests.geometry import ZONE_SCHEMA, box, line, multiline, multipolygon, polygon, shapes_frame, two_zones


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_point_inside_kept_and_border_point_dropped(spark):
    pts = spark.createDataFrame([("in", 5.0, 5.0), ("edge", 10.0, 5.0), ("out", 50.0, 5.0)], "fid string, x double, y double")
    assert pairs(sj.assign_points(pts, two_zones(spark)), "fid", "zone_id") == [("in", "T1")]
    touching = sj.assign_points(pts, two_zones(spark), predicate=sj.INTERSECTS)
    assert pairs(touching, "fid", "zone_id") == [("edge", "T1"), ("edge", "T2"), ("in", "T1")]


def test_building_rules(spark):
    b = shapes_frame(spark, {"straddle": box(7, 2, 11, 4), "inner": box(2, 2, 4, 4)})
    zones = two_zones(spark)
    assert pairs(sj.assign_by_centroid(b, zones), "fid", "zone_id") == [("inner", "T1"), ("straddle", "T1")]
    crossing = sj.assign_by_intersection(b, zones, ["fid"])
    assert pairs(crossing, "fid", "zone_id") == [("inner", "T1"), ("straddle", "T1"), ("straddle", "T2")]


def test_lines_are_clipped_and_vertex_touch_gives_no_row(spark):
    rows = {"long": line((0, 5), (20, 5)), "short": line((9, 5), (11, 5)), "touch": line((10, 10), (15, 15))}
    lines, zones = shapes_frame(spark, rows), two_zones(spark)
    clipped = sj.clip_lines(lines, zones, ["fid"])
    length = F.aggregate("clipped", F.lit(0.0), lambda acc, s: acc + sj.planar_measure(s))
    found = {(r[0], r[1]): r[2] for r in clipped.select("fid", "zone_id", length).collect()}
    assert set(found) == {("long", "T1"), ("long", "T2"), ("short", "T1"), ("short", "T2")}
    assert found[("long", "T1")] == pytest.approx(found[("long", "T2")], rel=1e-9) == pytest.approx(10.0)
    assert found[("short", "T1")] > 0 and found[("short", "T2")] > 0
    touched = sj.touching_lines(lines, zones, ["fid"])
    assert ("touch", "T1") in pairs(touched, "fid", "zone_id")


def test_line_along_shared_border_counts_for_both(spark):
    lines = shapes_frame(spark, {"border": line((10, 1), (10, 9))})
    total = sj.clipped_length(lines, two_zones(spark), ["fid"], measure="planar")
    assert sorted(tuple(r) for r in total.collect()) == [("T1", pytest.approx(8.0)), ("T2", pytest.approx(8.0))]


def test_multipart_line_is_one_row_per_zone(spark):
    lines = shapes_frame(spark, {"m": multiline([(1, 1), (3, 1)], [(5, 5), (12, 5)])})
    rows = {r["zone_id"]: r["clipped"] for r in sj.clip_lines(lines, two_zones(spark), ["fid"]).collect()}
    assert [len(rows["T1"]), len(rows["T2"])] == [2, 1]


def test_features_of_one_zone_and_neighbours(spark):
    b = shapes_frame(spark, {"a": box(1, 1, 2, 2), "b": box(9, 1, 11, 2), "c": box(15, 1, 16, 2)})
    first = two_zones(spark).filter("zone_id = 'T1'")
    assert pairs(sj.features_of_zone(b, first, ["fid"]).dropDuplicates(["fid"]), "fid") == [("a",), ("b",)]


def test_boundary_audit(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 99.0, 5.0), (4, 0.0, 0.0)], "fid int, x double, y double")
    row = sj.boundary_audit(pts.withColumn("layer", F.lit("p")), two_zones(spark), ["fid"], ["layer"]).first()
    assert (row["total"], row["within"], row["boundary_only"], row["outside"], row["boundary_pct"]) == (4, 1, 2, 1, 50.0)


def test_definedness_by_touch_and_by_length(spark):
    zones = two_zones(spark).withColumn("region", F.lit("r"))
    lines = shapes_frame(spark, {"touch": line((10, 10), (5, 15)), "inside": line((12, 2), (13, 2))})
    row = audit.definedness(lines, sj.ZoneIndex(zones), zones, ["fid"], near_zero=10, measure="planar").first()
    assert (row["n_zones"], row["undefined_by_touch"], row["undefined_by_length"], row["near_zero"]) == (2, 0, 1, 1)


def test_distance_to_boundary(spark):
    pts = spark.createDataFrame([("a", 5.0, 5.0), ("b", 1.0, 8.0), ("c", 19.5, 5.0)], "fid string, x double, y double")
    placed = sj.distance_to_boundary(pts, two_zones(spark), projected=False)
    assert pairs(placed, "fid", "boundary_distance") == [("a", 5.0), ("b", 1.0), ("c", 0.5)]


def test_grid_is_broadcast_only_within_the_measured_bound(spark):
    grid = choose_grids(two_zones(spark))[0]
    assert grid.can_broadcast and grid.tile_bytes < 1_000_000
    assert not Grid(1.0, BROADCAST_BYTES + 1).can_broadcast


# --- brute force on irregular zones ---------------------------------------------------------


def star(rng, cx, cy, radius, n):
    import math

    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    out = []
    for a in angles:
        r = rng.uniform(radius / 3, radius)
        p = (round(cx + r * math.cos(a)), round(cy + r * math.sin(a)))
        if not out or out[-1] != p:
            out.append(p)
    return out


def irregular(rng):
    """Integer-coordinate zones, so every orientation test is exact in floating point."""
    zones = {}
    for i in range(5):
        for j in range(5):
            cx, cy = 40 * i + 20, 40 * j + 20
            zones[f"z{i}{j}"] = polygon(star(rng, cx, cy, 30, rng.randint(4, 40)))
    zones["ring"] = polygon([(0, 0), (60, 0), (60, 60), (0, 60)], [(20, 20), (40, 20), (40, 40), (20, 40)])
    zones["two"] = multipolygon([[(100, 100), (120, 100), (110, 130)]], [[(150, 150), (170, 150), (170, 170), (150, 170)]])
    zones["huge"] = box(-50, -50, 250, 250)
    return zones


def edges_of(geom):
    return [
        (a["x"], a["y"], b["x"], b["y"])
        for part in geom["parts"]
        for r in part
        for a, b in zip(r, r[1:])
        if (a["x"], a["y"]) != (b["x"], b["y"])
    ]


def side(e, x, y):
    return (e[2] - e[0]) * (y - e[1]) - (x - e[0]) * (e[3] - e[1])


def on_edge(e, x, y):
    return (
        side(e, x, y) == 0
        and min(e[0], e[2]) <= x <= max(e[0], e[2])
        and min(e[1], e[3]) <= y <= max(e[1], e[3])
    )


def locate(edges, x, y):
    if any(on_edge(e, x, y) for e in edges):
        return -1
    inside = False
    for e in edges:
        if (e[1] > y) != (e[3] > y):
            if (side(e, x, y) > 0) == (e[3] > e[1]):
                inside = not inside
    return int(inside)


def touch(a, b):
    d = [side(b, a[0], a[1]), side(b, a[2], a[3]), side(a, b[0], b[1]), side(a, b[2], b[3])]
    if d[0] * d[1] < 0 and d[2] * d[3] < 0:
        return True
    return on_edge(b, a[0], a[1]) or on_edge(b, a[2], a[3]) or on_edge(a, b[0], b[1]) or on_edge(a, b[2], b[3])


def shapes_meet(a, b):
    ea, eb = edges_of(a), edges_of(b)
    if any(touch(x, y) for x in ea for y in eb):
        return True
    return any(locate(eb, e[0], e[1]) != 0 for e in ea) or any(locate(ea, e[0], e[1]) != 0 for e in eb)


def inside_length(edges, seg, steps=None):
    """Length of the segment inside the closed zone, from exact crossing parameters."""
    from fractions import Fraction as Q

    x1, y1, x2, y2 = (Q(v) for v in seg)
    dx, dy = x2 - x1, y2 - y1
    cuts = {Q(0), Q(1)}
    for e in edges:
        ax, ay, bx, by = (Q(v) for v in e)
        ex, ey = bx - ax, by - ay
        turn = dx * ey - dy * ex
        if turn:
            cuts.add(((ax - x1) * ey - (ay - y1) * ex) / turn)
        else:
            for px, py in ((ax, ay), (bx, by)):
                cuts.add(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))
    stops = sorted(t for t in cuts if 0 <= t <= 1)
    exact = [tuple(Q(v) for v in e) for e in edges]
    kept = sum(
        b - a for a, b in zip(stops, stops[1:]) if locate(exact, x1 + (a + b) / 2 * dx, y1 + (a + b) / 2 * dy) != 0
    )
    return float(kept) * float(dx * dx + dy * dy) ** 0.5


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    zones = irregular(rng)
    return rng, zones, shapes_frame(spark, zones, ZONE_SCHEMA)


@pytest.mark.parametrize("broadcast", [True, False])
def test_points_equal_brute_force(spark, world, broadcast):
    rng, zones, frame = world
    pts = [(i, float(rng.randint(-60, 260)), float(rng.randint(-60, 260))) for i in range(3000)]
    grid = choose_grids(frame)[0]
    if not broadcast:
        grid = Grid(grid.size, BROADCAST_BYTES + 1, grid.vertices)
    index = sj.ZoneIndex(frame, grids=[grid])
    found = sj.assign_hits(spark.createDataFrame(pts, "fid int, x double, y double"), index)
    got = {(r["fid"], r["zone_id"]): r["location"] for r in found.collect()}
    want = {}
    for name, geom in zones.items():
        edges = edges_of(geom)
        for i, x, y in pts:
            where = locate(edges, x, y)
            if where:
                want[(i, name)] = where
    assert got == want
    assert -1 in want.values()


@pytest.mark.parametrize("broadcast", [True, False])
def test_polygons_equal_brute_force(spark, world, broadcast):
    rng, zones, frame = world
    shapes = {}
    for i in range(250):
        x, y = rng.randint(-60, 250), rng.randint(-60, 250)
        w, h = rng.choice([(1, 1), (3, 2), (10, 4), (60, 60), (130, 3)])
        shapes[f"b{i}"] = box(x, y, x + w, y + h) if i % 3 else polygon(star(rng, x, y, 8, 7))
    shapes = {k: v for k, v in shapes.items() if len(edges_of(v)) >= 3}
    grid = choose_grids(frame)[0]
    if not broadcast:
        grid = Grid(grid.size * 0.7, BROADCAST_BYTES + 1, grid.vertices)
    index = sj.ZoneIndex(frame, grids=[grid])
    layer = shapes_frame(spark, shapes)
    got = set(pairs(sj.assign_by_intersection(layer, index, ["fid"]), "fid", "zone_id"))
    want = {(f, z) for f, a in shapes.items() for z, b in zones.items() if shapes_meet(a, b)}
    assert got == want
    counts = {r["zone_id"]: r["n"] for r in sj.count_pairs(sj.polygon_pairs(layer, index, ["fid"]), ["fid"]).collect()}
    assert counts == {z: sum(1 for _, other in want if other == z) for z in {z for _, z in want}}


def test_one_pass_counts_equal_the_two_rules(spark, world):
    rng, _, frame = world
    layer = shapes_frame(spark, {f"b{i}": box(x := rng.randint(0, 200) + 0.25, y := rng.randint(0, 200) + 0.25, x + 3, y + 5) for i in range(200)})
    index = sj.ZoneIndex(frame)
    both = sj.count_pairs(sj.polygon_pairs(layer, index, ["fid"], centre="planar"), ["fid"], name="touching", flags={"centred": "centred"})
    centred = sj.assign_by_centroid(layer, index, centroid_space="planar").groupBy("zone_id").count()
    touching = sj.assign_by_intersection(layer, index, ["fid"]).groupBy("zone_id").count()
    assert {r["zone_id"]: r["touching"] for r in both.collect()} == {r[0]: r[1] for r in touching.collect()}
    assert {r["zone_id"]: r["centred"] for r in both.collect() if r["centred"]} == {r[0]: r[1] for r in centred.collect()}


def test_lines_equal_brute_force(spark, world):
    rng, zones, frame = world
    segs = {}
    for i in range(300):
        x, y = rng.randint(-60, 250), rng.randint(-60, 250)
        dx, dy = rng.choice([(0, 7), (9, 0), (rng.randint(-80, 80), rng.randint(-80, 80)), (rng.randint(-5, 5), 3)])
        if (dx, dy) != (0, 0):
            segs[f"l{i}"] = (x, y, x + dx, y + dy)
    lines = shapes_frame(spark, {k: line(s[:2], s[2:]) for k, s in segs.items()})
    index = sj.ZoneIndex(frame)
    lengths, touching = {}, set()
    for name, geom in zones.items():
        edges = edges_of(geom)
        for k, s in segs.items():
            value = inside_length(edges, s)
            if value > 0:
                lengths[(k, name)] = value
            if any(touch(s, e) for e in edges) or locate(edges, s[0], s[1]) != 0:
                touching.add((k, name))
    total = F.aggregate("clipped", F.lit(0.0), lambda acc, s: acc + sj.planar_measure(s))
    clipped = sj.clip_lines(lines, index, ["fid"]).select("fid", "zone_id", total.alias("length"))
    got = {(r[0], r[1]): r[2] for r in clipped.collect()}
    assert set(got) == set(lengths)
    assert all(got[k] == pytest.approx(v, rel=1e-9) for k, v in lengths.items())
    per_zone = {r["zone_id"]: r["length"] for r in sj.clipped_length(lines, index, ["fid"], measure="planar").collect()}
    for name in zones:
        assert per_zone.get(name, 0.0) == pytest.approx(sum(v for (_, z), v in lengths.items() if z == name), rel=1e-9)
    assert set(pairs(sj.touching_lines(lines, index, ["fid"]), "fid", "zone_id")) == touching


def test_hot_cell_is_split(spark):
    """All points in one cell: adaptive execution splits the shuffled join's partition."""
    grid = choose_grids(two_zones(spark))[0]
    index = sj.ZoneIndex(two_zones(spark), grids=[Grid(grid.size, BROADCAST_BYTES + 1)])
    # One cell, but not constants, which the optimizer would turn into a filter.
    here = F.lit(5.0) + F.rand(1) * 1e-3
    pts = spark.range(0, 40_000, 1, 8).select("id", here.alias("x"), here.alias("y"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        placed = sj.assign_points(pts, index)
        assert len(placed.collect()) == 40_000
        plan = placed._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)
    assert "skew=true" in plan


def test_uneven_zones_have_tiles_in_proportion_to_their_number(spark):
    """Many small and some very large zones: each class has a grid of its own."""
    small = {f"s{i}": box(3 * i, 0, 3 * i + 1, 1) for i in range(400)}
    large = {f"l{i}": box(300 * i, 10, 300 * i + 290, 300) for i in range(4)}
    zones = shapes_frame(spark, small | large, ZONE_SCHEMA)
    index = sj.ZoneIndex(zones)
    assert len(index.levels) == 2 and all(level.grid.can_broadcast for level in index.levels)
    assert sum(level.tiles.count() for level in index.levels) < 150 * (len(small) + len(large))
    pts = spark.createDataFrame([(i, 0.5 + 3 * i, 0.5) for i in range(400)] + [(1000 + i, 300.0 * i + 7, 50.0) for i in range(4)], "fid int, x double, y double")
    got = dict(pairs(sj.assign_points(pts, index), "fid", "zone_id"))
    assert got == {i: f"s{i}" for i in range(400)} | {1000 + i: f"l{i}" for i in range(4)}
    lines = shapes_frame(spark, {"a": line((0.5, 0.5), (0.5, 20)), "b": line((0, 0.5), (9, 0.5))})
    lengths = {r["zone_id"]: r["length"] for r in sj.clipped_length(lines, index, ["fid"], measure="planar").collect()}
    assert lengths == {"s0": pytest.approx(1.5), "l0": pytest.approx(10.0), "s1": pytest.approx(1.0), "s2": pytest.approx(1.0)}
    assert set(pairs(sj.touching_lines(lines, index, ["fid"]), "fid", "zone_id")) == {("a", "s0"), ("a", "l0"), ("b", "s0"), ("b", "s1"), ("b", "s2"), ("b", "s3")}


def test_coordinates_that_are_no_numbers_match_nothing(spark):
    bad = (float("nan"), float("inf"), float("-inf"), None)
    zones = shapes_frame(spark, {"T1": box(0, 0, 10, 10)}, ZONE_SCHEMA)
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(b, 5.0) for b in bad] + [(5.0, b) for b in bad] + [(5.0, 5.0), (1e300, 5.0)])], "fid int, x double, y double")
    assert pairs(sj.assign_points(pts, zones), "fid", "zone_id") == [(8, "T1")]
    nan, inf = float("nan"), float("inf")
    polygons = shapes_frame(spark, {"ok": box(1, 1, 2, 2), "nan": box(nan, 1, 2, 2), "inf": box(1, 1, inf, 2)})
    assert pairs(sj.assign_by_intersection(polygons, zones, ["fid"]), "fid", "zone_id") == [("ok", "T1")]
    lines = shapes_frame(spark, {"ok": line((1, 1), (2, 1)), "nan": line((nan, 1), (2, 2)), "inf": line((1, 1), (inf, 1))})
    assert pairs(sj.clipped_length(lines, zones, ["fid"], measure="planar"), "zone_id", "length") == [("T1", pytest.approx(1.0))]
    assert pairs(sj.touching_lines(lines, zones, ["fid"]), "fid", "zone_id") == [("ok", "T1")]


def test_no_zone_has_no_features(spark):
    b = shapes_frame(spark, {"a": box(1, 1, 2, 2)})
    nothing = two_zones(spark).filter("zone_id = 'absent'")
    assert sj.features_of_zone(b, nothing, ["fid"]).count() == 0
    assert sj.assign_by_intersection(b, nothing, ["fid"]).count() == 0


def test_boundary_audit_with_overlapping_zones(spark):
    zones = shapes_frame(spark, {"A": box(0, 0, 10, 10), "B": box(5, 5, 15, 15)}, ZONE_SCHEMA)
    pts = spark.createDataFrame([(1, 7.0, 7.0), (2, 10.0, 7.0), (3, 0.0, 3.0)], "fid int, x double, y double").withColumn("layer", F.lit("p"))
    row = sj.boundary_audit(pts, zones, ["fid"], ["layer"], disjoint=False).first()
    assert (row["within"], row["boundary_only"], row["outside"]) == (2, 1, 0)
