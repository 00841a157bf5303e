"""Spark types of geometry columns and kernel results."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

DOUBLE, INT, BOOL, TEXT, BINARY = DoubleType(), IntegerType(), BooleanType(), StringType(), BinaryType()


def struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


RING = ArrayType(struct(x=DOUBLE, y=DOUBLE))
GEOM = struct(kind=TEXT, parts=ArrayType(ArrayType(RING)))
MEASURES = struct(
    xmin=DOUBLE, ymin=DOUBLE, xmax=DOUBLE, ymax=DOUBLE, n_points=INT, area=DOUBLE, length=DOUBLE, cx=DOUBLE, cy=DOUBLE
)
SPANS = ArrayType(struct(ta=DOUBLE, tb=DOUBLE))
TILES = ArrayType(struct(cx=INT, cy=INT, core=BOOL, parity=INT, edges=BINARY))
NESTED = ArrayType(struct(_level=INT, cx=INT, cy=INT, core=BOOL, parity=INT, edges=BINARY))
NEAR = ArrayType(struct(cx=INT, cy=INT, core=BOOL, parity=INT, edges=BINARY, near=BINARY))
COVER = ArrayType(struct(kind=INT, level=INT, cx=INT, cy=INT, parity=INT, edges=BINARY))
PREPARED = struct(mx=DOUBLE, my=DOUBLE, cover=COVER)
HITS = struct(touches=BOOL, centred=BOOL)
#: What a (polygon, zone) pair tells besides its zones.
PAIR_MARKS = {"many_cells": BOOL, "n_zones": INT, "touches": BOOL, "centred": BOOL}
CLIPPED = struct(spans=SPANS, length=DOUBLE)
VALIDITY = struct(valid=BOOL, reason=TEXT)
