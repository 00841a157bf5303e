"""Findings of the third round: polygons meet their zones in one row each."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from coverlay.functions import shapes
from coverlay.operators import spatial_join as sj
from coverlay.plans import audit
from coverlay.queries import CHECKS, QUERIES


def square_zones(spark, side=4, step=20.0):
    x, y = (F.col("id") % side) * step, F.floor(F.col("id") / side) * step
    return spark.range(side * side).select(F.col("id").cast("string").alias("zone_id"), shapes.box_geom(x, y, x + step, y + step).alias("geom"))


def boxes(spark, n=4000, half=0.7):
    x, y = (F.col("id") * 7919) % 8000 / 100.0, (F.col("id") * 104729) % 8000 / 100.0
    side = F.when(F.col("id") % 97 == 0, 6.0).otherwise(half)
    return spark.range(n).select(F.col("id").alias("fid"), (F.col("id") % 2).alias("side"), shapes.box_geom(x - side, y - side, x + side, y + side).alias("geom"))


def want(n=4000, half=0.7):
    out = {}
    for i in range(n):
        x, y, h = i * 7919 % 8000 / 100.0, i * 104729 % 8000 / 100.0, 6.0 if i % 97 == 0 else half
        out[i] = (x, y, {z for z in range(16) if x - h <= z % 4 * 20 + 20 and x + h >= z % 4 * 20 and y - h <= z // 4 * 20 + 20 and y + h >= z // 4 * 20})
    return out


def test_narrow_polygons_meet_each_zone_once_and_wide_ones_are_counted_by_id(spark):
    zones, layer, expected = sj.ZoneIndex(square_zones(spark)), boxes(spark), want()
    rows = sj.polygon_pairs(layer, zones, ["fid"]).select("fid", "zone_id", "many_cells", "n_zones").collect()
    once = [(r.fid, r.zone_id) for r in rows if not r.many_cells]
    # Before, a box across cells came once per cell and was marked as spanning many.
    assert len(once) == len(set(once)) and {f for f, _ in once} == {i for i in range(4000) if i % 97}
    assert all(r.n_zones == len(expected[r.fid][2]) for r in rows if not r.many_cells)
    assert all(r.n_zones is None for r in rows if r.many_cells)
    assert {(r.fid, int(r.zone_id)) for r in rows} == {(i, z) for i, (_, _, met) in expected.items() for z in met}
    got = {r.n_zones: r.n for r in sj.features_by_zones(layer, zones, ["fid"]).collect()}
    sizes = [len(met) for _, _, met in expected.values() if met]
    assert got == {k: sizes.count(k) for k in set(sizes)}
    assert sj.assign_by_intersection(layer, zones, ["fid"]).count() == sum(sizes)


def test_centroid_explain_counts_narrow_and_wide_features(spark):
    rows = audit.centroid_explain(boxes(spark), sj.ZoneIndex(square_zones(spark)), ["fid"], "side", centroid_space="planar").collect()
    got = {(int(r.zone_id), r.side): (r.intersecting, r.centroid_within, r.centroid_elsewhere, r.centroid_nowhere) for r in rows}
    expected = {}
    for i, (x, y, met) in want().items():
        on_line = x % 20 == 0 or y % 20 == 0
        home = None if on_line or not (0 < x < 80 and 0 < y < 80) else int(y // 20) * 4 + int(x // 20)
        for z in met:
            t = expected.setdefault((z, i % 2), [0, 0, 0, 0])
            t[0] += 1
            t[1 if home == z else 3 if home is None else 2] += 1
    assert got == {k: tuple(v) for k, v in expected.items()}


def test_many_zones_in_one_window_continue_in_further_rows(spark):
    zones = spark.range(60).select(F.col("id").cast("string").alias("zone_id"), shapes.box_geom(F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(20.0)).alias("geom"))
    index = sj.ZoneIndex(zones)
    layer = spark.range(3).select(F.col("id").alias("fid"), shapes.box_geom(F.lit(1.9), F.lit(1.9), F.lit(3.1), F.lit(3.1)).alias("geom"))
    rows = sj.polygon_pairs(layer, index, ["fid"]).collect()
    assert sorted((r.fid, int(r.zone_id)) for r in rows) == [(f, z) for f in range(3) for z in range(60)]
    assert {r.n for r in sj.features_by_zones(layer, index, ["fid"]).filter("n_zones = 60").collect()} == {3}


def against_sql(spark, name, folder, tables):
    db = duckdb.connect()
    for table in tables:
        path = f"{folder}/{table}.parquet"
        db.execute(f"CREATE VIEW {table} AS FROM read_parquet('{path}/*.parquet')")
    rows = QUERIES[name](spark, folder)
    wanted = db.execute(CHECKS[name]).fetchall()
    columns = [c[0] for c in db.description]
    return sorted(map(repr, map(tuple, rows.select(*columns).collect()))), sorted(map(repr, wanted))


def test_reclassified_where_part_keys_exceed_five_digits(spark, tmp_path):
    keys = spark.range(9_900, 130_000, 7)
    size = (F.col("id") * 31 % 50).cast("int")
    keys.select(F.col("id").alias("p_partkey"), size.alias("p_size"), (900.0 + F.col("id") % 100).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(9_900, 130_000, 5).select(F.col("id").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, wanted = against_sql(spark, "reclassified", str(tmp_path), ["part", "lineitem"])
    assert got == wanted


def test_rows_per_file_of_tables_in_several_files(spark, tmp_path):
    from coverlay.queries.quality import TABLES

    for i, name in enumerate(TABLES):
        spark.range(0, i * 10, 1, 3 if i else 1).write.parquet(f"{tmp_path}/{name}.parquet")
    got, wanted = against_sql(spark, "rows_per_file", str(tmp_path), TABLES)
    assert got == wanted and len(got) == len(TABLES)


def test_encoding_hands_arrays_to_arrow(spark):
    from coverlay.llm import pieces
    from coverlay.llm.queries import VOCABULARY

    vocabulary = pieces.load_vocabulary(VOCABULARY)
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, None), (3, ""), (4, "你 ▁x")], "doc_id long, text string")
    encoded = pieces.encode_texts(docs, vocabulary)
    # Before, every id went through pandas objects.
    assert "MapInArrow" in encoded._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.doc_id: r for r in encoded.collect()}
    assert rows[2].ids is rows[2].others is rows[2].scores is rows[2].exact is None
    assert (rows[3].ids, rows[3].others, rows[3].scores, rows[3].exact) == ([], [], [0.0], True)
    encoder = pieces.Encoder(vocabulary)
    for i in (1, 4):
        ids, scores, spell = next(encoder.encode([rows[i].text], 3))
        assert rows[i].ids == ids.tolist() and rows[i].scores == scores and rows[i].exact
        assert [rows[i].ids, *map(list, rows[i].others)] == list(map(list, spell()))


def test_signing_holds_few_shuffles_of_places_at_once():
    import tracemalloc

    import pandas as pd

    from coverlay.llm import superminhash as smh

    texts = [" ".join(f"w{i}_{j}" for j in range(100)) for i in range(2200)]
    part = pd.DataFrame({"key": range(2200), "none": False, "digest": "", "text": texts})
    tracemalloc.start()
    (signed,) = smh._signer(3, 4)(iter([part]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Before, 200,000 elements held 100 MB of places, and a copy of them.
    assert peak < 120e6
    (alone,) = smh._signer(3, 4)(iter([part.iloc[:5]]))
    assert [list(b) for b in signed["bands"][:5]] == [list(b) for b in alone["bands"]]


def test_faults_of_simple_rings_are_named_without_the_general_check(monkeypatch):
    import pyarrow as pa

    from coverlay.functions import kernels

    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(point))))])

    def ring(*corners):
        return {"kind": "POLYGON", "parts": [[[{"x": float(x), "y": float(y)} for x, y in (*corners, corners[0])]]]}

    rows = [
        ring((0, 0), (1, 1), (1, 0), (0, 1)), ring((0, 0), (1, 0), (1, 1), (0, 1)), None,
        ring((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)), {"kind": "POINT", "parts": [[[{"x": 1.0, "y": 2.0}]]]},
    ]
    asked = []
    general = kernels._polygon_reason
    monkeypatch.setattr(kernels, "_polygon_reason", lambda parts: asked.append(parts) or general(parts))
    found = [r["reason"] for r in kernels.validity(pa.array(rows, kind)).to_pylist()]
    assert found == ["Self-intersection", "Valid Geometry", None, "Ring Self-intersection", "Valid Geometry"]
    # Before, each faulty ring went through the general check on its own.
    assert not asked
