"""Reading map layers: WKB geometry is decoded once at ingest, into the geometry struct plus
its bounding box, so that everything downstream works on columns and can prune by box."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from coverlay.functions import types, wkb
from coverlay.operators.contracts import Contract, ContractViolation, enforce, require_text_key
from coverlay.operators.spatial_join import window_read, with_bounds
from coverlay.sources.contracts import LAYER_CONTRACTS

KEY = "GEOID"


@F.arrow_udf(types.GEOM)
def decode_wkb(blob: pa.Array) -> pa.Array:
    return wkb.decode(blob)


@F.arrow_udf(types.BINARY)
def encode_wkb(geom: pa.Array) -> pa.Array:
    return wkb.encode(geom)


def read_flat(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Plain Parquet; a missing path raises ``FileNotFoundError`` naming it."""
    paths = [path] if isinstance(path, str) else list(path)
    try:
        return spark.read.parquet(*paths)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such table: {paths}") from problem
        raise


def decode_geometry(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Replace a WKB column by ``geom`` and ``xmin, ymin, xmax, ymax``."""
    once = decode_wkb.asNondeterministic()
    return with_bounds(df.withColumn("geom", once(geometry)).drop(geometry))


def read_geo(spark: SparkSession, path: str | list[str], geometry: str = "geometry") -> DataFrame:
    df = read_flat(spark, path)
    if geometry not in df.columns:
        raise ContractViolation(f"{path}: no {geometry!r} column, found {df.columns}")
    return decode_geometry(df, geometry)


def read_any(spark: SparkSession, path: str | list[str], geometry: str = "geometry") -> DataFrame:
    """Geometry decoded where the table has it, flat otherwise; no contract applied."""
    df = read_flat(spark, path)
    has_wkb = geometry in df.columns and isinstance(df.schema[geometry].dataType, BinaryType)
    return decode_geometry(df, geometry) if has_wkb else df


def read_columns(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Only the named columns are read; names the table lacks are left out, none left is an error."""
    df = read_flat(spark, path)
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ContractViolation(f"{path}: none of {columns} present, found {df.columns}")
    return df.select(*present)


def read_regions(spark: SparkSession, root: str, regions: list[str] | None = None) -> DataFrame:
    """All regions of a ``region=`` partitioned table in one scan; a filter prunes partitions."""
    df = read_flat(spark, root)
    return df if regions is None else df.filter(F.col("region").isin(regions))


def read_window(
    spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float, bbox: str | None = "bbox"
) -> DataFrame:
    """Rows whose stored box meets the window, pruned in the scan before anything is decoded.

    On a layer written by ``layout.write_layer`` the scan skips the row groups elsewhere.
    """
    return window_read(read_flat(spark, path), xmin, ymin, xmax, ymax, bbox)


def count_by_file(df: DataFrame) -> DataFrame:
    """Rows per source file, reading no column."""
    return df.select(F.input_file_name().alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))


def first_rows(spark: SparkSession, path: str, columns: list[str], rows: int = 100_000) -> DataFrame:
    """The leading rows of a table's first file that has any, of some columns.

    One task walks through the file's splits in turn and stops at the wanted row, so what is
    read does not grow with the table.  Only the list of file names passes the driver.
    """
    files = sorted(read_flat(spark, path).inputFiles())
    for file in files:
        some = spark.read.parquet(file).select(*columns).coalesce(1).limit(rows)
        if not some.isEmpty():
            return some
    return read_flat(spark, path).select(*columns).limit(rows)


def coordinate_report(df: DataFrame) -> DataFrame:
    """Rows outside the lon/lat range, and rows that only fit with the axes swapped."""
    inside = (F.col("xmin") >= -180) & (F.col("xmax") <= 180) & (F.col("ymin") >= -90) & (F.col("ymax") <= 90)
    swapped = (F.col("ymin") >= -180) & (F.col("ymax") <= 180) & (F.col("xmin") >= -90) & (F.col("xmax") <= 90)
    known = F.col("xmin").isNotNull()
    return df.agg(
        F.count_if(known).alias("n_geometries"),
        F.count_if(known & ~inside).alias("out_of_range"),
        F.count_if(known & ~inside & swapped).alias("swapped_axes"),
    )


def require_lonlat(df: DataFrame) -> DataFrame:
    """Refuse a layer whose coordinates cannot be lon/lat degrees."""
    seen = coordinate_report(df).first()
    if seen["out_of_range"]:
        raise ContractViolation(f"layer is not lon/lat: {seen.asDict()}")
    return df


def require_kind(df: DataFrame, allowed: tuple[str, ...], geom: str = "geom") -> DataFrame:
    """Refuse a layer holding other geometry kinds; NULL geometry is not a kind."""
    kind = F.col(geom)["kind"]
    odd = [r[0] for r in df.filter(~kind.isin(list(allowed))).select(kind).distinct().collect()]
    if odd:
        raise ContractViolation(f"expected {allowed} geometry, found {sorted(odd)}")
    return df


def guard_lonlat(df: DataFrame) -> DataFrame:
    """The rows as they are; one outside the lon/lat range fails the query that reads it.

    Unlike ``require_lonlat`` this reads nothing ahead, so geometry is decoded once, for use.
    """
    inside = (F.col("xmin") >= -180) & (F.col("xmax") <= 180) & (F.col("ymin") >= -90) & (F.col("ymax") <= 90)
    box = F.concat_ws(", ", *[F.col(n).cast("string") for n in ("xmin", "ymin", "xmax", "ymax")])
    failure = F.raise_error(F.concat(F.lit("layer is not lon/lat: box "), box)).cast("double")
    return df.withColumn("xmin", F.when(inside | F.col("xmin").isNull(), F.col("xmin")).otherwise(failure))


def checked_layer(df: DataFrame, layer: str) -> DataFrame:
    """A raw layer through its contract (one aggregate), decoded, with the coordinate guard."""
    contract: Contract | None = LAYER_CONTRACTS.get(layer)
    if contract is None:
        raise NotImplementedError(f"no contract for layer {layer!r}; known: {sorted(LAYER_CONTRACTS)}")
    return guard_lonlat(decode_geometry(enforce(df, contract)))


def load_layer(spark: SparkSession, path: str | list[str], layer: str) -> DataFrame:
    """Reference or observed layer from its files, checked and decoded."""
    return checked_layer(read_flat(spark, path), layer)


def load_strata_geo(spark: SparkSession, path: str | list[str], key: str = KEY) -> DataFrame:
    """Strata table with geometry (regional or national): decode, coordinate and key guards."""
    return require_text_key(guard_lonlat(read_geo(spark, path)), key)


def load_strata_flat(spark: SparkSession, path: str | list[str], key: str = KEY) -> DataFrame:
    """Attribute-only strata table: key guard only."""
    return require_text_key(read_flat(spark, path), key)
