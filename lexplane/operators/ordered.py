"""Ordered-state operators: carry-forward, runs, numbering, and greedy choice of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order)))


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """A row for each run of equal values: by, run (from 1), value, length; in one ordering of the rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w))
    return marked.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def unique_ids(df: DataFrame, by: list[str], order: list[str], base: str, name: str = "id") -> DataFrame:
    """base, with _2, _3, ... from its second use on."""
    out = numbered(df, [*by, base], order, "__n")
    return out.withColumn(name, F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.col("__n").cast("string")))).drop("__n")


def lookahead(df: DataFrame, by: list[str], order: list[str], depth: str, name: str = "has_nested") -> DataFrame:
    """Whether the next row is deeper."""
    return df.withColumn(name, F.lead(depth, 1, 0).over(Window.partitionBy(*by).orderBy(*order)) > F.col(depth))


def pick_spans(spans: Column) -> Column:
    """Of an array of structs (start, end, kind, ...) those kept when read by start, longest first, def before internal
    before external, and a span that starts before the end of the last kept one is dropped. A fold inside the row."""
    rank = lambda s: F.struct(s["start"], -(s["end"] - s["start"]), F.when(s["kind"] == "def", 0).when(s["kind"] == "ref_internal", 1).otherwise(2), s.alias("span"))
    ordered = F.transform(F.array_sort(F.transform(spans, rank)), lambda r: r["span"])
    start = F.struct(F.lit(-1).cast("long").alias("cursor"), F.slice(ordered, 1, 0).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["cursor"], acc).otherwise(F.struct(s["end"].cast("long").alias("cursor"), F.concat(acc["out"], F.array(s)).alias("out")))

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def list_depths(blocks: Column) -> Column:
    """Depths of an article's blocks, array of structs (depth, kind, text) in order.

    A given depth stays. A lettered or Roman block is one level down while a list is open, or after a numbered block
    or one that ends in a colon; any other closes the list.
    """
    zero = F.struct(F.lit(False).alias("open"), F.lit("none").alias("kind"), F.lit("").alias("text"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, b: Column) -> Column:
        nested = b["kind"].isin("alpha", "roman") & (a["open"] | a["kind"].isin("numeric", "dotted_numeric") | a["text"].endswith(":"))
        given = F.struct(a["open"].alias("open"), a["kind"].alias("kind"), a["text"].alias("text"), F.concat(a["out"], F.array(b["depth"].cast("int"))).alias("out"))
        down = F.struct(F.lit(True).alias("open"), a["kind"].alias("kind"), a["text"].alias("text"), F.concat(a["out"], F.array(F.lit(1))).alias("out"))
        top = F.struct(F.lit(False).alias("open"), b["kind"].alias("kind"), F.trim(b["text"]).alias("text"), F.concat(a["out"], F.array(F.lit(0))).alias("out"))
        return F.when(b["depth"] > 0, given).when(nested, down).otherwise(top)

    return F.aggregate(blocks, zero, step, lambda a: a["out"])
