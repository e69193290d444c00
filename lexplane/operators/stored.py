"""Graphs kept as tables bucketed and sorted by subject: what groups or joins by subject reads them without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .triples import COLUMNS


def store(triples: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """triples as table name, its files below path, in so many buckets of subjects, each sorted by subject, predicate and object.

    Equal triples count once. A bucket is written by one task, so buckets should grow with the graph: some 100 MB each.
    """
    kept = triples.select(*COLUMNS).dropDuplicates(COLUMNS).repartition(buckets, "s")
    kept.write.mode("overwrite").option("path", path).bucketBy(buckets, "s").sortBy("s", "p", "o").saveAsTable(name)
    return triples.sparkSession.table(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def in_order(stored: DataFrame) -> DataFrame:
    """The triples with each subject's together, by predicate and object, without a shuffle: no order among subjects."""
    return stored.sortWithinPartitions("s", "p", "o")
