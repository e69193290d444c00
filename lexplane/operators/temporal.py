"""Versions in time: as-of lookups without range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(targets: DataFrame, versions: DataFrame, by: str, at: str, value: str, order: str, bucket: Column | None = None) -> DataFrame:
    """targets with value and its time, value_at: of the last version of the same by at or before the target's at; null before the first.

    versions has by, at, value, and order, which decides between versions of one time. Both are put in one ordered
    stream, so work is linear. With bucket, an expression over at that never falls as at rises, a hot key is spread:
    each bucket is ordered alone, and starts from the last version of the buckets before, of which there is one each.
    """
    bucket = F.lit(0) if bucket is None else bucket
    latest = F.struct(F.col(at).alias("at"), F.col(order).alias("order"), F.col(value).alias("value"))
    v = versions.select(F.col(by).alias("__by"), F.col(at), latest.alias("__v")).withColumn("__bucket", bucket).drop(at)
    carried = v.groupBy("__by", "__bucket").agg(F.max("__v").alias("__last"))
    rows = targets.withColumn("__by", F.col(by)).withColumn("__bucket", bucket)
    stream = rows.select("__by", "__bucket", F.struct(*targets.columns).alias("__row"), F.lit(None).cast(v.schema["__v"].dataType).alias("__v"), F.col(at).alias("__at"), F.lit(1).alias("__kind"))
    stream = stream.unionByName(v.select("__by", "__bucket", F.lit(None).cast(stream.schema["__row"].dataType).alias("__row"), "__v", F.col("__v.at").alias("__at"), F.lit(0).alias("__kind")))
    w = Window.partitionBy("__by", "__bucket").orderBy("__at", "__kind", "__v.order")
    stream = stream.withColumn("__here", F.last("__v", ignorenulls=True).over(w)).where("__row is not null")
    spans = rows.select("__by", "__bucket").distinct().join(carried, ["__by", "__bucket"], "full")
    before = Window.partitionBy("__by").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).drop("__last").where("__before is not null")
    joined = stream.join(spans, ["__by", "__bucket"], "left")
    found = F.coalesce("__here", "__before")
    return joined.select("__row.*", found["value"].alias(value), found["at"].alias("value_at"))


def version_range(versions: DataFrame, by: str, at: str) -> DataFrame:
    return versions.groupBy(by).agg(F.count("*").alias("n_versions"), F.min(at).alias("earliest"), F.max(at).alias("latest"))


def version_of_file(name: Column) -> Column:
    """Date from which a version file counts: in its name, or that of the original text; null for other files."""
    dated = F.regexp_extract(name, r"VIGENZA_(\d{4}-\d{2}-\d{2})_V\d+\.xml$", 1)
    return F.when(dated != "", F.try_to_date(dated)).when(name.endswith("ORIGINALE_V0.xml"), F.lit("1941-07-16").cast("date"))
