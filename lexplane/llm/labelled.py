"""Bounded samples of labelled rows, and the split into rows to learn from and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: Column, rows: int) -> DataFrame:
    """(text, y) of at most about rows documents that have a label y and are not held out.

    target is an expression over labels. Where there are more labels, a hash of the id chooses, the same each time. A
    document with several labels has the highest. The chosen ids are few by that bound, and are broadcast.
    """
    usable = labels.select(F.col("doc_id").alias("id"), target.alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = usable.count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))  # other columns may have any names
    return texts.join(F.broadcast(usable), "id").select("text", "y")
