"""Line dedup by site-relative frequency: lines that stand on too large a share of a site's pages are boilerplate.

Each page's distinct lines are counted per host as 128-bit digests, partial counts first, so that a hot host or line
is one row per task in the shuffle. By the pigeonhole a host has at most (its mean distinct lines per page / ratio)
boilerplate lines, so they travel back to the pages as one short array per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, fresh

WHITE = "\t\n\x0b\f\r "


def _digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g"))


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def host_of(url: Column) -> Column:
    """The host that a URL names, in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def boilerplate(scratch: Scratch, pages: DataFrame, host: str | Column, text: str = "text", ratio: float = 0.1, least: int = 3) -> DataFrame:
    """(host, lines array<struct<h,g>>): each host's lines that are on more than ratio of its pages and on least pages.

    Lines are compared without white space at their ends; blank lines never count. A null host is a host of its own.
    """
    src = pages.select((F.col(host) if isinstance(host, str) else host).alias("host"), F.col(text).alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), _stripped))
    counts = src.select("host", F.explode(F.filter(lines, lambda x: x != "")).alias("line")).select("host", _digest(F.col("line")).alias("line"))
    common = counts.groupBy("host", "line.h", "line.g").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = scratch.table(common, "common-lines")
    totals = broadcast_if_small(scratch.table(src.groupBy("host").agg(F.count("*").alias("pages")), "totals"))
    named = totals.withColumnRenamed("host", "host_")
    over = common.join(named, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return scratch.table(over.groupBy("host").agg(F.collect_list(F.struct("h", "g")).alias("lines")), "boilerplate")


def drop_boilerplate(scratch: Scratch, pages: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = 0.1, least: int = 3) -> DataFrame:
    """pages with the text cleaned, and n_lines and n_dropped added.

    A page that consists of boilerplate alone keeps its row with an empty text; a null text stays null with no lines.
    Repeated rows count as pages each. Other columns pass through, except that n_lines and n_dropped are replaced.
    host: the column of the site, or an expression such as host_of(F.col("url")).
    """
    src = pages.drop("n_lines", "n_dropped")
    bad_, host_, kept_ = fresh(src, "__bad"), fresh(src, "__host"), fresh(src, "__kept")
    bad = boilerplate(scratch, src, host, text, ratio, least).select(F.col("host").alias(host_), F.col("lines").alias(bad_))
    bad = broadcast_if_small(bad, cells=F.size(bad_))
    joined = src.join(bad, (F.col(host) if isinstance(host, str) else host).eqNullSafe(F.col(host_)), "left").drop(host_)
    split = F.split(text, "\n")
    kept = F.when(F.col(bad_).isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains(F.col(bad_), _digest(_stripped(x)))))
    out = joined.withColumn(kept_, kept).withColumn("n_lines", F.coalesce(F.size(F.when(F.col(text).isNotNull(), split)), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines") - F.size(kept_)).cast("long"))
    cleaned = F.when(F.col("n_dropped") > 0, F.array_join(kept_, "\n")).otherwise(F.col(text))
    return out.withColumn(text, cleaned).drop(kept_, bad_)
