"""Layers stored so that a window reads only what lies near it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlay.functions.shapes import BOUNDS

#: Rows of a file and bytes of a row group, about.
ROWS_PER_FILE, ROW_GROUP_BYTES = 2_000_000, 16 * 1024 * 1024
#: Bits of each coordinate in the order of the rows.
BITS = 16


def _spread_bits(number: Column) -> Column:
    """The lowest 16 bits of a number with a zero between any two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        number = (number.bitwiseOR(F.shiftleft(number, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return number


def curve_key(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """Place of a point on a Z-shaped curve through the extent: neighbours have near keys.

    NULL for coordinates that are no finite numbers.
    """
    low_x, low_y, high_x, high_y = extent
    top = (1 << BITS) - 1

    def step(v: Column, low: float, high: float) -> Column:
        share = (v - low) / (high - low) if high > low else F.lit(0.0)
        return F.when(F.abs(v) < math.inf, F.least(F.greatest(F.floor(share * top), F.lit(0)), F.lit(top)).cast("long"))

    return _spread_bits(step(x, low_x, high_x)).bitwiseOR(F.shiftleft(_spread_bits(step(y, low_y, high_y)), 1))


def write_layer(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write a layer with ``xmin, ymin, xmax, ymax`` in the order of a space-filling curve.

    The four bounds become the struct ``bbox``, whose statistics each row group keeps.  Files
    are ranges of the curve, cut also between rows of one place, so that no place makes a
    task of its own; features without a box come first.  An empty layer is written too.
    """
    centre = [(F.col(a) + F.col(b)) / 2 for a, b in (("xmin", "xmax"), ("ymin", "ymax"))]
    finite = [F.when(F.abs(c) < math.inf, c) for c in centre]
    low_x, low_y, high_x, high_y, n = df.agg(F.min(finite[0]), F.min(finite[1]), F.max(finite[0]), F.max(finite[1]), F.count(F.lit(1))).first()
    extent = (0.0, 0.0, 0.0, 0.0) if low_x is None or low_y is None else (low_x, low_y, high_x, high_y)
    other = [c for c in df.columns if c not in BOUNDS]
    row = F.struct(*other, F.struct(*BOUNDS).alias("bbox"))
    keyed = df.select(row.alias("row"), curve_key(*centre, extent).alias("place"), F.xxhash64(*BOUNDS, *other).alias("turn"))
    ranged = keyed.repartitionByRange(max(1, -(-n // rows_per_file)), "place", "turn").sortWithinPartitions("place", "turn")
    ranged.select("row.*").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)
