"""Connected components as alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlay.operators.lineage import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: each node of the edges with the smallest node it can reach.

    Every round hangs a node's larger neighbours on its smallest one (large star), then its
    smaller neighbours (small star), until only stars are left.  A hub's neighbours are
    reduced to a minimum map-side and its rows are joined to that one row, so no task holds
    a neighbourhood.  Null ends and loops are ignored; no edges give no rows.
    """
    proper = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stars = settle(proper.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _settled(stars):
        stars = settle(_small_star(_large_star(stars)))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether each child has one parent and no child is a parent."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
                F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")),
            )
        ).alias("end")
    ).select("end.*")
    seen = ends.groupBy("node").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
    return seen.filter((F.col("children") > 1) | ((F.col("children") > 0) & (F.col("parent") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()
