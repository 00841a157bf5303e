"""Cutting lineage where a small, expensive table is read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's checkpoint folder and continue from there.

    For small tables whose inputs are large, and for the rounds of an iteration: later steps
    read the written rows instead of repeating the work, and losing an executor loses
    nothing.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path, under the folder for checkpoints, that driver and executors share."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where the session names none, one in
    the warehouse, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", shared))
    return context.getCheckpointDir()
