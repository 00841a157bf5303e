"""Bounded samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlay.llm.columns import fold_of
from coverlay.operators.lineage import settle


#: Label values that are learned at most, the most frequent first.
CLASSES = 1000
#: Bytes of text in a sample at most, an equal share for each label value.
SAMPLE_BYTES = 128 << 20


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    folds: int,
    held_out: int,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    classes: int = CLASSES,
    sample_bytes: int = SAMPLE_BYTES,
) -> list[tuple[str, object]]:
    """At most ``per_class`` texts of each label value, as ``text, label`` in a fixed order.

    Rows whose fold ``crc32(key as text) % folds`` is ``held_out`` are left out, and so are
    null keys, texts and labels.  Which rows: those with the smallest hash of the key, then
    of the text, while a label's texts hold its share of ``sample_bytes`` at most (a longer
    one is passed over); rows of one key and text count once.  Of more than ``classes`` label values the
    most frequent are learned, ties to the smaller.  Ids are bounded before any text is read
    and texts before any reaches the driver.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold_of(F.col(key), folds) != held_out))
    usable = usable.select(F.col(key).alias("id"), F.col(label).alias("label"))
    learned = usable.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(classes).select("label")
    learned = settle(learned)
    class_bytes = sample_bytes // max(learned.count(), 1)
    order = F.xxhash64(F.lit(seed), "id").alias("order")
    # Equal rows of one id would fill the places of others.
    ids = usable.join(F.broadcast(learned), "label").groupBy("label", "id").agg(F.first(order).alias("order"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("order", "id"))).filter(F.col("n") <= per_class).drop("n")
    # At most per_class * classes ids.
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(ids), "id")
    sized = found.groupBy("label", "order", "id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes")).agg(F.first("text").alias("text"))
    sized = sized.filter(F.col("bytes") <= class_bytes)
    first = Window.partitionBy("label").orderBy("order", "id", "hash", "bytes")
    sized = sized.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_class)
    running = F.sum("bytes").over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = sized.withColumn("held", running).filter(F.col("held") <= class_bytes).orderBy("order", "id", "hash", "label").select("text", "label").collect()
    return [(r["text"], r["label"]) for r in rows]


def held_out_flag(key: Column, folds: int, held_out: int) -> Column:
    return fold_of(key, folds) == held_out
