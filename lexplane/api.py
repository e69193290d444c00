"""The engine as Python calls: what a service or a command line would offer, over DataFrames.

Each call is a plan over the tables it was given; the batch forms (all jurisdictions, all questions) are the same
plans without a filter.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import locate, temporal
from .operators import triples as G
from .operators.render import html
from .plans import rules
from .sources import akn, facts


class Engine:
    """triples: the graph; docs (doc, xml): texts by path; versions (code, at, file): dated texts of a jurisdiction."""

    def __init__(self, triples: DataFrame, docs: DataFrame, versions: DataFrame | None = None, enricher: Callable[[DataFrame], DataFrame] = rules.enrich):
        self.triples, self.docs, self.versions, self.enricher = triples, docs, versions, enricher
        self.nodes = akn.nodes(docs).persist()  # every call reads it several times; lost parts are parsed again
        self.spark: SparkSession = triples.sparkSession

    def ask(self, questions: DataFrame) -> DataFrame:
        """questions (question): evidence with the passage that the cited article has, or a sentence in its place, and the whole answer."""
        found = rules.evidence(rules.route(self.enricher(questions)), self.triples)
        found = self._with_passages(found.withColumnsRenamed({"path": "doc", "article": "ref"})).withColumn("passage", F.coalesce(F.nullif("passage", F.lit("")), "answer"))
        return found.withColumn("card", rules.card(F.col("rule"))).withColumn("text", rules.full_answer(F.col("answer"), F.col("passage"), F.col("ref"), F.col("title"), F.col("doc"), F.col("country")))

    def _with_passages(self, rows: DataFrame) -> DataFrame:
        at = locate.find(rows.select("doc", "ref").distinct(), self.nodes)
        return rows.join(locate.passages(at, self.nodes), ["doc", "ref"], "left")

    def compliance(self, code: str | None = None) -> DataFrame:
        """The verdict of one jurisdiction or of all, with the passage; no row for an unknown one."""
        found = rules.compliance(self.triples).withColumnsRenamed({"path": "doc", "article": "ref"})
        return self._with_passages(found if code is None else found.where(F.col("code") == code))

    def document(self, targets: DataFrame) -> DataFrame:
        """targets (code, at, eid, span): file, its date, status and html of the version in force at each date.

        status: resolved, before_first (with the range), invalid_date for a null one, or missing_provision.
        """
        v = self.versions.withColumn("version", F.col("file"))
        found = temporal.asof(targets, v, "code", "at", "version", "file", F.year("at"))
        ranges = temporal.version_range(self.versions, "code", "at")
        out = found.join(ranges, "code", "left").join(self.docs, F.col("doc") == F.col("version"), "left")
        out = out.withColumn("html", html(F.col("xml"), F.col("eid"), F.col("span")))
        status = F.when(F.col("at").isNull(), "invalid_date").when(F.col("version").isNull(), "before_first").when(F.col("html") == "", "missing_provision").otherwise("resolved")
        return out.withColumn("status", status).drop("xml", "doc")

    def versions_of(self, code: str) -> DataFrame:
        return self.versions.where(F.col("code") == code).orderBy("at", "file")

    def graph(self, code: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Vertices, edges and triples of a jurisdiction; all empty for an unknown one."""
        arms = {"code": "legal:jurisdiction", "name": "legal:jurisdictionName", "rule": "legal:ruleType"}
        nodes = G.star(self.triples, arms, {"title": "legal:docTitle"}).where(F.col("code") == code.strip().upper()).withColumn("title", F.coalesce("title", F.lit("")))
        return rules.vertices(nodes), rules.edges(nodes), G.subgraph(self.triples, [nodes]).orderBy("s", "p", "o")

    def countries(self) -> DataFrame:
        return self.spark.createDataFrame([(n, *c) for n, c in enumerate(rules.COUNTRIES)], "ordinal int, code string, name string").orderBy("ordinal").drop("ordinal")


def main(args: list[str] | None = None) -> int:
    """Build the graph from a facts file, write it as N-Triples, and print all verdicts as JSON lines."""
    from .session import local_session

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("facts")
    p.add_argument("out")
    a = p.parse_args(args)
    spark = local_session()
    documents = spark.createDataFrame([], "code string, rule string, path string, title string")
    graph = facts.triples(facts.read(spark, a.facts), documents).cache()
    G.to_ntriples(graph).write.mode("overwrite").text(a.out)
    for row in rules.compliance(graph).orderBy("code").toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
