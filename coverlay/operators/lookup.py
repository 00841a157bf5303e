"""Joins on keys of very uneven frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds at least this part of all rows counts as heavy, so at most as many keys
#: are: what is broadcast is bounded whatever the data.
HEAVY_KEYS = 10_000


def lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: Column | int, found: str, spread: Sequence[Column | str]
) -> DataFrame:
    """Left join that adds ``found``, the table's other columns as a struct (null: no match).

    ``table`` has unique ``keys`` and ``weight``, the number of ``total`` that a key stands
    for.  Heavy keys, ``HEAVY_KEYS`` at most, are broadcast; a row that finds one, or has a
    null key, is dealt by ``spread`` in the shuffle of the others, so no task holds the rows
    of a hot key.
    """
    values = [c for c in table.columns if c not in keys]
    heavy_enough = (F.col(weight).cast("double") * HEAVY_KEYS >= total).alias("_lookup_heavy")
    # Zero, but not as a constant, which the optimizer would take out of the join's keys.
    parts = table.select(*keys, F.struct(*values).alias("_lookup_value"), heavy_enough, F.least(F.col(weight), F.lit(0)).cast("long").alias("_lookup_turn"))
    heavy = parts.filter("_lookup_heavy").select(*keys, F.col("_lookup_value").alias("_lookup_first"))
    light = parts.filter("not _lookup_heavy").select(*keys, "_lookup_turn", F.col("_lookup_value").alias("_lookup_second"))
    known = rows.join(F.broadcast(heavy), list(keys), "left")
    # Zero, the turn of the light keys, for rows that still look for theirs.
    looking = F.col("_lookup_first").isNull()
    for key in keys:
        looking &= F.col(key).isNotNull()
    turn = F.when(looking, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(2**40)))
    joined = known.withColumn("_lookup_turn", turn.cast("long")).join(light, [*keys, "_lookup_turn"], "left")
    return joined.select(*rows.columns, F.coalesce("_lookup_first", "_lookup_second").alias(found))
