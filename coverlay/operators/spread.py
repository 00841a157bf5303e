"""Partition-level helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTING = "spark.coverlay.scanPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out again where the session asks for it and the scan leaves cores idle.

    A benchmark's tables are single files of one row group, which one core would read; its
    session names a number of partitions.  Without the setting the scan stays as it is, and
    so does one whose rows lie well apart already: shuffling them would take the table's size on disk.
    """
    wanted = int(df.sparkSession.conf.get(SETTING, "0"))
    return df.repartition(wanted) if wanted and not _is_even(df, wanted) else df


def _is_even(df: DataFrame, parts: int) -> bool:
    """Whether no partition holds more than twice the share of one of ``parts``.

    A split without the middle of a row group is empty, so rows are counted, not partitions;
    of a scan this reads the files' footers only.
    """
    if 2 * df.rdd.getNumPartitions() < parts:
        return False
    per = df.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    most, total = per.agg(F.max("_n"), F.sum("_n")).first()
    return not total or most * parts <= 2 * total
