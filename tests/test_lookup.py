"""Lookups by key and ranks where one value holds most rows; row numbers of stored rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coverlay.operators import lookup as heavy
from coverlay.operators import spatial_join as sj
from coverlay.operators.ordering import average_ranks
from coverlay.sources.row_ids import read_numbered
from tests.geometry import two_zones


def test_lookup_splits_heavy_keys(spark, monkeypatch):
    """A key with most rows is found by broadcast, its rows are dealt over the shuffle."""
    monkeypatch.setattr(heavy, "HEAVY_KEYS", 3)
    rows = spark.range(2000).select(F.when(F.col("id") % 10 > 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k != 20")
    got = heavy.lookup(rows, table, ["k"], "n", 2000, "found", ["id"])
    want = {r["k"]: r["n"] for r in table.collect()}
    found = got.collect()
    assert len(found) == 2000 and all((r["found"]["n"] if r["found"] else None) == want.get(r["k"]) for r in found)


def rows_per_task(df):
    return sorted((r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)


def mean_ranks(values):
    known = sorted(v for v in values if v is not None)
    return [None if v is None else known.index(v) + (known.count(v) + 1) / 2 for v in values]


@pytest.mark.parametrize("keys", [3, 10_000])
def test_ranks_with_one_value_on_a_third_of_the_rows(spark, monkeypatch, keys):
    monkeypatch.setattr(heavy, "HEAVY_KEYS", keys)
    values = [7 if i % 3 == 0 else None if i % 3 == 1 and i % 2 else (i * 37) % 211 for i in range(3000)]
    df = spark.createDataFrame([(i, v, -1, "x") for i, v in enumerate(values)], "id long, v int, _value int, n string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = average_ranks(df, {"v": "rank"})
        assert got.columns == [*df.columns, "rank"]
        ranks = {r["id"]: r["rank"] for r in got.collect()}
        tasks = rows_per_task(got)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [ranks[i] for i in range(3000)] == mean_ranks(values)
    # A third of the rows on one value, a third without: either would fill a task of its own.
    assert len(tasks) == 8 and tasks[0] < 600


def test_ranks_per_group(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0), (None, 3.0), ("b", None)]
    got = average_ranks(spark.createDataFrame(rows, "g string, v double"), {"v": "r"}, ["g"])
    assert sorted((r["g"] or "", r["v"] or 0, r["r"]) for r in got.filter("g is not null").collect()) == [("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 5.0, 3.0), ("b", 0, None), ("b", 2.0, 1.0)]


def stored(spark, folder, n=5000):
    rows = spark.range(n).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 2100 / 100.0).alias("x"), ((F.col("id") * 31) % 1100 / 100.0).alias("y"))
    rows.repartition(3, "k").write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(folder)


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    folder = str(tmp_path / "layer")
    stored(spark, folder)
    reads = []
    for size in ("3000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            df = read_numbered(spark, folder, ["k"])
            reads.append((df.rdd.getNumPartitions(), {r["k"]: r["row_id"] for r in df.collect()}))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    (many, first), (few, second) = reads
    assert many > few and first == second and sorted(first.values()) == list(range(1, 5001))
    # In each file the numbers follow the stored order.
    for file in sorted(Path(folder).glob("*.parquet")):
        import pyarrow.parquet as pq

        numbers = [first[k] for k in pq.read_table(file, columns=["k"]).column("k").to_pylist()]
        assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    with pytest.raises(ValueError):
        read_numbered(spark, folder, name="x")
    spark.createDataFrame([], "k int").write.parquet(str(tmp_path / "none"))
    assert read_numbered(spark, str(tmp_path / "none")).count() == 0


def test_boundary_audit_by_row_number(spark, tmp_path):
    """Equal rows are counted one by one: the stored row is what is compared."""
    folder = str(tmp_path / "points")
    spark.createDataFrame([(5.0, 5.0), (5.0, 5.0), (10.0, 5.0), (10.0, 5.0), (99.0, 5.0)], "x double, y double").write.parquet(folder)
    pts = read_numbered(spark, folder).withColumn("layer", F.lit("p"))
    row = sj.boundary_audit(pts, two_zones(spark), ["row_id"], ["layer"], disjoint=False).first()
    assert (row["total"], row["within"], row["boundary_only"], row["outside"]) == (5, 2, 2, 1)
