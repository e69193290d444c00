"""Commands: convert treaty HTML to Akoma Ntoso with an index, mark definitions and references in it, validate it with a report, build the graph of facts.

Each is one Spark job over a whole folder; run with spark-submit, or alone on one machine.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import assemble, convert, enrich, schema, validate
from .sources import akn, files, html, markup, treaties


def convert_folder(spark: SparkSession, source: str, out: str) -> DataFrame:
    """The known treaties' HTML files below source as documents (out/akn) and their index (out/index); counters for each.

    Files that the registry lacks, and those whose name starts with '_', are left out. delta and status tell how far a
    document's text is from its source's: FAIL beyond one percent.
    """
    known = treaties.known(akn.read_texts(spark, source).withColumnsRenamed({"doc": "file", "xml": "html"})).withColumnRenamed("file", "doc")
    found = convert.blocks(html.entries(known), known.select("doc", html.title(F.col("html")).alias("title"))).persist()
    nodes = convert.article_nodes(found).persist()
    docs = assemble.documents(found, nodes, known).persist()
    assemble.write(docs, f"{out}/akn")
    uri = F.concat(F.lit("/akn/un/act/"), F.col("kind"), F.lit("/wipo/"), "date", F.lit("/"), "short_name")
    treaties.write_index(docs.join(known.select("doc", "kind"), "doc").select("file", "short_name", "date", uri.alias("work_uri")), f"{out}/index")
    judged = convert.faithful(docs, found).select("doc", "seg", "file", "short_name", "date", "delta", "status")
    judged.join(convert.counters(nodes, found), ["doc", "seg"], "left").na.fill(0).write.mode("overwrite").parquet(f"{out}/counters")
    for held in (docs, nodes, found):
        held.unpersist()
    return spark.read.parquet(f"{out}/counters")


def enrich_folder(spark: SparkSession, source: str, out: str, index: str | None = None) -> tuple[DataFrame, int]:
    """The XML files below source with definitions and references as elements, under their names below out.

    A row for each file and one for all (is_total): defs, refs_internal, refs_external, delta, status, failed; and the
    exit code: 1 without input, 2 if a file was reverted or is no XML. index: the metadata index, from which treaties'
    names get their targets; else the documents' own.
    """
    original = files.contents(spark, source)
    if original.isEmpty():
        return spark.createDataFrame([], "doc string, is_total int, files long, status string, defs long, refs_internal long, refs_external long, delta double, failed long"), 1
    parts = markup.parts(original).persist()
    uris = treaties.work_uris(akn.frbr(akn.nodes(original)), None if index is None else treaties.read_index(spark, index))
    new = enrich.checked(enrich.enriched(parts, treaties.ALIASES, treaties.alias_uris(uris)), original).persist()
    files.write(new.select(F.col("doc").alias("file"), "content"), out)
    enrich.totals(new, ["defs", "refs_internal", "refs_external", "delta"]).write.mode("overwrite").parquet(f"{out}/_counters")
    for held in (new, parts):
        held.unpersist()
    found = spark.read.parquet(f"{out}/_counters")
    return found, 0 if found.where("is_total = 1").first().failed == 0 else 2


def validate_folder(spark: SparkSession, source: str, out: str) -> tuple[str, int]:
    """Check the documents below source and write the report, a JSON line for each and the summary in out/_summary; the line to print and the exit code."""
    nodes = akn.nodes(akn.read_texts(spark, source)).persist()
    reports = validate.report(nodes, schema.errors(nodes)).persist()
    validate.as_json(reports).write.mode("overwrite").text(out)
    validate.summary(reports).write.mode("overwrite").json(f"{out}/_summary")
    row = validate.console(validate.summary(reports)).first()
    reports.unpersist()
    nodes.unpersist()
    return row["line"], row["exit_code"]


def main(args: list[str] | None = None) -> int:
    from .session import local_session

    p = argparse.ArgumentParser(description=__doc__)
    names = p.add_subparsers(dest="name", required=True)
    for name, first in (("convert", "source"), ("enrich", "source"), ("validate", "source"), ("graph", "facts")):
        command = names.add_parser(name)
        command.add_argument(first)
        command.add_argument("out")
        if name == "enrich":
            command.add_argument("--index")
    a = p.parse_args(args)
    if a.name == "graph":
        return api.main([a.facts, a.out])
    spark = SparkSession.getActiveSession() or local_session()
    if a.name == "validate":
        line, code = validate_folder(spark, a.source, a.out)
        print(line)
        return code
    if a.name == "enrich":
        rows, code = enrich_folder(spark, a.source, a.out, a.index)
        for r in rows.orderBy("is_total", "doc").toLocalIterator():
            head = f"{r.files} files, {r.failed} failed" if r.is_total else f"{r.status} {r.doc}, {r.delta:.2f} % of text changed"
            print(f"{head}: {r.defs} definitions, {r.refs_internal} internal and {r.refs_external} external references")
        if code == 1:
            print(f"no XML files in {a.source}", file=sys.stderr)
        return code
    failed = n = 0
    for row in convert_folder(spark, a.source, a.out).orderBy("doc", "seg").toLocalIterator():
        n += 1
        print(f"{row.file}: {row.articles} articles, {row.paragraphs} paragraphs, {row.preamble} lines of preamble")
        if row.status != "OK":
            failed += 1
            print(f"FAIL {row.file}: {row.delta:.2f} % of the text differ from the source", file=sys.stderr)
    return 1 if n == 0 else 2 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
