"""Windows over layers stored along a curve: what is skipped, and what is found."""

import math
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from coverlay.sources import geo, layout

LAYER = "id int, _key string, xmin double, ymin double, xmax double, ymax double"


def boxes(rng, n):
    rows = []
    for i in range(n):
        # A third of the rows in one place.
        x, y = (40.0, 40.0) if i % 3 == 0 else (rng.uniform(0, 100), rng.uniform(-50, 50))
        rows.append((i, f"k{i}", x, y, x + rng.random(), y + rng.random()))
    return rows


def row_groups(folder):
    """Rows and box of each row group, from the footers."""
    out = []
    for file in Path(folder).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            box = [stats["bbox.xmin"].min, stats["bbox.ymin"].min, stats["bbox.xmax"].max, stats["bbox.ymax"].max]
            out.append((group.num_rows, *box))
    return out


def rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_window_skips_row_groups(spark, tmp_path):
    rows, folder = boxes(random.Random(5), 30_000), str(tmp_path / "layer")
    layout.write_layer(spark.createDataFrame(rows, LAYER), folder, rows_per_file=8_000, row_group_bytes=20_000)
    window = (60.0, -20.0, 68.0, -11.0)
    groups = row_groups(folder)
    near = [n for n, x1, y1, x2, y2 in groups if x1 <= window[2] and x2 >= window[0] and y1 <= window[3] and y2 >= window[1]]
    assert len(groups) > 30 and len(near) < len(groups) / 4 and sum(n for n, *_ in groups) == len(rows)
    # No file is all of the crowded place's and none much larger than the others.
    sizes = sorted(pq.ParquetFile(f).metadata.num_rows for f in Path(folder).glob("*.parquet"))
    assert len(sizes) == 4 and sizes[-1] < 16_000
    hits = geo.read_window(spark, folder, *window)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "bbox.xmin" in plan[plan.index("PushedFilters") :]
    assert rows_scanned(hits.select("id")) <= sum(near)
    got = sorted(r["id"] for r in hits.select("id").collect())
    assert got == [i for i, _, x1, y1, x2, y2 in rows if x1 <= window[2] and x2 >= window[0] and y1 <= window[3] and y2 >= window[1]]


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None, None, None)], [(1, "a", 2.0, 2.0, 2.0, 2.0)] * 3, [(1, "a", math.nan, 0.0, 1.0, 1.0), (2, "b", 0.0, 0.0, math.inf, 1.0), (3, "c", 0.0, 0.0, 1.0, 1.0)]])
def test_odd_layers_are_stored_whole(spark, tmp_path, rows):
    folder = str(tmp_path / "layer")
    layout.write_layer(spark.createDataFrame(rows, LAYER), folder)
    back = spark.read.parquet(folder).select("id", "_key", "bbox.*")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, spark.createDataFrame(rows, LAYER).collect()))


def test_curve_keys_interleave_the_bits(spark):
    pts = spark.createDataFrame([(float(x), float(y)) for x in (0, 1, 5, 65535) for y in (0, 2, 65535)], "x double, y double")
    keys = {(r["x"], r["y"]): r["k"] for r in pts.withColumn("k", layout.curve_key(F.col("x"), F.col("y"), (0.0, 0.0, 65535.0, 65535.0))).collect()}
    want = lambda x, y: sum(((int(x) >> b) & 1) << (2 * b) | ((int(y) >> b) & 1) << (2 * b + 1) for b in range(16))
    assert keys == {(x, y): want(x, y) for x, y in keys}
