"""Row numbers that belong to the stored row: file and place in it, not task and order.

A number drawn from the partition a row happens to be in changes with split sizes, and may
change when a lost task runs again.  These come from the scan's own metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverlay.operators.tiling import join_small
from coverlay.sources.geo import read_flat

#: Tables of up to so many files have their offsets (a path and a number each) broadcast.
FILES = 100_000


def file_offsets(table: DataFrame) -> DataFrame:
    """``file, before``: rows in the files that come before, by path; one row per file.

    The counts come from the files' footers: no column is read.
    """
    counts = table.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))


def read_numbered(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, name: str = "row_id") -> DataFrame:
    """Stored rows with ``name``: 1, 2, ... in the order of the files' paths and of their rows.

    Equal for every read of the same files, however they are split or retried; a table
    without rows has no numbers.  ``name`` must not be a column of the table.
    """
    table = read_flat(spark, path)
    if name in table.columns:
        raise ValueError(f"column exists already: {name}")
    kept = list(columns) if columns is not None else table.columns
    rows = table.select(*kept, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_row"))
    joined = join_small(rows, file_offsets(table), ["file"], len(table.inputFiles()) <= FILES)
    return joined.select(*kept, (F.col("before") + F.col("_row") + 1).alias(name))
