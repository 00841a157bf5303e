"""Findings of the third round, F2 to F5 and F10: what waits for Python, and what is shuffled for it."""

from __future__ import annotations

import pytest

from coverlay.operators import spatial_join as sj
from coverlay.plans import audit
from coverlay.queries import QUERIES
from tests.test_findings_r03 import boxes, square_zones, want

DATA = "/root/testdata/sf0.001"
SHARED = ["centroid_explain", "centroid_explain_gaps", "straddling_buildings", "buildings_intersect_zones", "wkb_ingest", "zone_ingredients"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", SHARED)
def test_tiles_do_not_wait_in_the_queue_of_a_udf(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert "MapInArrow" in plan
    # Before, each polygon waited with its window's tiles until Python had answered.
    assert not [line for line in plan.splitlines() if "ArrowEvalPython" in line and "tiles#" in line]


def test_pairs_carry_the_columns_that_are_asked_for(spark):
    index, layer = sj.ZoneIndex(square_zones(spark)), boxes(spark)
    pairs = sj.polygon_pairs(layer, index, ["fid"], centre="planar", keep=["fid"])
    assert set(pairs.columns) == {"fid", "zone_id", "home", "many_cells", "n_zones", "touches", "centred"}
    full = sj.assign_by_intersection(layer, index, ["fid"])
    assert {"fid", "side", "geom", "zone_id"} <= set(full.columns)
    shapes = {r.fid: r.geom for r in layer.collect()}
    found = full.select("fid", "zone_id", "geom").collect()
    assert all(r.geom == shapes[r.fid] for r in found)
    assert {(r.fid, int(r.zone_id)) for r in found} == {(i, z) for i, (_, _, met) in want().items() for z in met}


def test_home_is_the_least_zone_that_holds_the_centroid(spark):
    from pyspark.sql import functions as F

    from coverlay.functions import shapes

    both = square_zones(spark, side=1).select(F.explode(F.array(F.lit("b"), F.lit("a"))).alias("zone_id"), "geom")
    layer = spark.range(1).select(F.col("id").alias("fid"), shapes.box_geom(F.lit(1.0), F.lit(1.0), F.lit(1.5), F.lit(1.5)).alias("geom"))
    rows = sj.polygon_pairs(layer, sj.ZoneIndex(both), ["fid"], centre="planar").collect()
    assert sorted((r.zone_id, r.home, r.n_zones) for r in rows) == [("a", "a", 2), ("b", "a", 2)]


@pytest.mark.parametrize("half", [0.7, 2.0])
def test_centroids_moved_come_from_the_pass_that_finds_the_pairs(spark, half):
    index = sj.ZoneIndex(square_zones(spark))
    moved = audit.centroids_moved(boxes(spark, half=half), index, ["fid"], "planar")
    # Before, each pair's polygon went through Python again for its centroid, and a second join.
    assert "_locate" not in plan_of(moved)
    expected = {}
    for x, y, met in want(half=half).values():
        if 0 < x < 80 and 0 < y < 80 and x % 20 and y % 20:
            home = int(y // 20) * 4 + int(x // 20)
            for z in met - {home}:
                expected[z, home] = expected.get((z, home), 0) + 1
    assert {(int(r.zone_id), int(r.home)): r.n for r in moved.collect()} == expected


def test_centroid_in_neighbour_decodes_no_centroid_apart(spark):
    plan = plan_of(QUERIES["centroid_in_neighbour"](spark, DATA))
    assert "MapInArrow" in plan and "_locate" not in plan and "_planar_measures" not in plan


def test_planar_lengths_are_summed_where_they_are_cut(spark):
    from pyspark.sql import functions as F

    from coverlay.functions import shapes

    index = sj.ZoneIndex(square_zones(spark))
    x, y = (F.col("id") * 37 % 170) / 2.0 - 2.5, (F.col("id") * 53 % 170) / 2.0 - 2.5
    # Steep, long and flat ones, and some along borders of cells and zones.
    ends = [(x, y), (x + (F.col("id") % 5) * 8.25, y + (F.col("id") % 4) * 12.5)]
    lines = spark.range(600).select(F.col("id").alias("fid"), (F.col("id") % 2).alias("side"), shapes.line_geom(ends).alias("geom"))
    lengths = sj.clipped_length(lines, index, ["fid"], by=["side"], measure="planar")
    # Before, the parts of every segment across cells were shuffled to be joined again.
    assert "collect_list" not in plan_of(lengths)
    got = {(r.zone_id, r.side): r.length for r in lengths.collect()}
    total = F.aggregate("clipped", F.lit(0.0), lambda acc, s: acc + sj.planar_measure(s))
    clipped = sj.clip_lines(lines, index, ["fid"], keep=["side"]).groupBy("zone_id", "side").agg(F.sum(total).alias("length"))
    wanted = {(r.zone_id, r.side): r.length for r in clipped.collect()}
    assert got.keys() == wanted.keys() and len(got) > 20
    assert all(got[k] == pytest.approx(wanted[k], rel=1e-12, abs=1e-9) for k in wanted)


@pytest.mark.parametrize(("files", "dealt"), [(16, False), (1, True)])
def test_a_scan_that_is_dealt_out_already_is_not_shuffled(spark, tmp_path, files, dealt):
    for name in ("nation", "region", "lineitem"):
        table = spark.read.parquet(f"{DATA}/{name}.parquet")
        (table.repartition(files) if name == "lineitem" else table).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.conf.set("spark.coverlay.scanPartitions", "8")
    try:
        gaps = QUERIES["centroid_explain_gaps"](spark, str(tmp_path))
        # Before, all rows were shuffled, however many row groups and files the table had.
        assert ("Repartition 8" in plan_of(gaps)) == dealt
        rows = sorted(map(tuple, gaps.collect()))
    finally:
        spark.conf.unset("spark.coverlay.scanPartitions")
    assert rows == sorted(map(tuple, QUERIES["centroid_explain_gaps"](spark, DATA).collect())) and len(rows) == 25


def test_a_scan_is_dealt_out_where_one_task_holds_most_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from coverlay.operators.spread import spread

    one_large = F.when(F.col("id") < 5000, 0).otherwise(F.col("id") % 16)
    spark.range(6000).repartitionByRange(16, one_large).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.coverlay.scanPartitions", "8")
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        # Partitions enough for 8, but one has the large file.
        assert table.rdd.getNumPartitions() >= 4 and "Repartition 8" in plan_of(spread(table))
        assert spread(table.filter("id < 0")).count() == 0
    finally:
        spark.conf.unset("spark.coverlay.scanPartitions")
