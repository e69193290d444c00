"""What enrichment works out for a document: each value once, not anew for each element that it is used for."""

from pyspark.sql import functions as F

from lexplane.operators import enrich
from lexplane.sources import markup

MARKS = "array<struct<start:long,end:long,open:string,again:string,close:string>>"


def test_splice_orders_borders_once(spark):
    df = spark.createDataFrame([], f"text string, events {markup.EVENTS}, marks {MARKS}")
    plan = df.select(enrich.splice(F.col("text"), F.col("events"), F.col("marks")).alias("xml"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("flatten(") <= 2  # pieces of all marks, and their borders
    assert plan.count("coalesce(events") == 1


def test_splice_without_marks_or_events(spark):
    rows = [("a < b", None, []), ("a < b", [], [(0, 1, "<m>", "<m>", "</m>"), (4, 5, "<n>", "<n>", "</n>")]), ("", None, [(0, 0, "<m>", "<m>", "</m>")])]
    df = spark.createDataFrame(rows, f"text string, events {markup.EVENTS}, marks {MARKS}")
    found = [r.xml for r in df.select(enrich.splice(F.col("text"), F.col("events"), F.col("marks")).alias("xml")).collect()]
    assert found == ["a &lt; b", "<m>a</m> &lt; <n>b</n>", "</m><m>"]
