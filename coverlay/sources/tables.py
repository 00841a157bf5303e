"""Key lists, crosswalks and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coverlay.functions.values import county_key
from coverlay.operators.contracts import require_columns, require_text_key

# Columns of the county crosswalk file.
CROSSWALK_COLUMNS = ("STFIPS", "CTYFIPS", "CODE2013", "CODE2023")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text: nothing is guessed, so no key loses zeros."""
    header = spark.read.option("header", True).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in header])
    return spark.read.option("header", True).schema(schema).csv(path)


def load_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("GEOID", "region")) -> DataFrame:
    """Authoritative key list; other columns are numbers where they parse as such."""
    raw = require_columns(read_csv_text(spark, path), required, "manifest")
    keep_text = {"GEOID", "region"}
    return require_text_key(
        raw.select(*[F.col(c) if c in keep_text else F.col(c).try_cast("double").alias(c) for c in raw.columns]),
        "GEOID",
    )


def load_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """County crosswalk with a normalised five-digit key."""
    raw = require_columns(read_csv_text(spark, path), CROSSWALK_COLUMNS, "crosswalk")
    return raw.withColumns(
        {
            "county_fips": county_key("STFIPS", "CTYFIPS"),
            "CODE2013": F.col("CODE2013").try_cast("double").cast("int"),
            "CODE2023": F.col("CODE2023").try_cast("double").cast("int"),
        }
    )


# Rows of an output file, about.
ROWS_PER_FILE = 2_000_000


def write_regions(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One directory per region, in files of about ``rows_per_file`` rows.

    A region gets as many files as its counted rows ask for, and its rows are dealt to them
    by a hash of their content, so that a region holding a third of all rows is written by
    many tasks and a small one makes a single file.
    """
    counts = df.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    total = counts.agg(F.coalesce(F.sum("_files"), F.lit(1))).first()[0]
    sized = df.join(counts.select(F.col("region").alias("_region"), "_files"), F.col("region").eqNullSafe(F.col("_region")))
    file = F.pmod(F.xxhash64(*df.columns), "_files")
    dealt = sized.withColumn("_file", file).repartition(int(total), "region", "_file")
    dealt.select(*df.columns).write.mode("overwrite").partitionBy("region").parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV report.  ``single_file`` suits outputs of one row per zone, not feature layers."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
