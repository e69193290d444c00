"""Checks over node tables: repeated ids, dangling references, undefined terms, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE = r"^/akn/un/act/[a-zA-Z0-9-]+/wipo/\d{4}-\d{2}-\d{2}/[a-z0-9-]+"
_EXPRESSION = _BASE + r"/eng@\d{4}-\d{2}-\d{2}"
#: Forms of the six identifiers.
FORMS = {"work_uri": _BASE + "$", "work_this": _BASE + "/!main$", "expr_uri": _EXPRESSION + "$", "expr_this": _EXPRESSION + "/!main$", "mani_uri": _EXPRESSION + r"\.xml$", "mani_this": _EXPRESSION + r"\.xml/!main$"}


def has_form(c: Column, form: str) -> Column:
    return F.coalesce(c.rlike(FORMS[form]), F.lit(False))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """(doc, eid, n) of ids (doc, eid) that occur more than once in a document."""
    return ids.where("eid is not null").groupBy("doc", "eid").agg(F.count("*").alias("n")).where("n > 1")


def missing_refs(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, href): internal references of refs (doc, href) without a target, each once."""
    targets = ids.select("doc", F.concat(F.lit("#"), "eid").alias("href")).where("href is not null")
    return refs.where(F.col("href").startswith("#")).select("doc", "href").distinct().join(targets, ["doc", "href"], "left_anti")


def undefined_terms(defs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, eid): definitions of defs (doc, eid, refers_to) that refer to no term of terms (doc, eid)."""
    known = terms.select("doc", F.concat(F.lit("#"), "eid").alias("refers_to")).where("refers_to is not null").distinct()
    return defs.join(known, ["doc", "refers_to"], "left_anti").select("doc", F.coalesce("eid", F.lit("(no-eId)")).alias("eid"))


LEVELS = {"work": "FRBRWork", "expr": "FRBRExpression", "mani": "FRBRManifestation"}
#: By level, the author's reference and role. A manifestation's author is the editor, a parameter.
EDITOR = "editor"
AUTHORS = {"work": ("#wipo", "#author"), "expr": ("#wipo", "#author"), "mani": (f"#{EDITOR}", "#editor")}


def _with_meta(lists: DataFrame) -> DataFrame:
    """lists with the elements that _meta_issues() asks for, found in meta: elements as array<struct<pre, parent, tag, attrs>> in document order.

    The levels are found before what is inside them, each once: a lookup inside another would be made for every element.
    """
    first = lambda test: F.get(F.filter("meta", test), F.lit(0))
    of_tag = lambda tag: first(lambda x: x["tag"] == tag)
    inside = lambda at, tag: first(lambda x: (x["tag"] == tag) & (x["parent"] == F.col(at)["pre"]))
    lists = lists.withColumns({f"__{level}": of_tag(tag) for level, tag in LEVELS.items()} | {f"__{tag}": of_tag(tag) for tag in ("identification", "references", "publication")})
    return lists.withColumns({f"__{level}_{child}": inside(f"__{level}", child) for level in LEVELS for child in ("FRBRuri", "FRBRthis", "FRBRauthor", "FRBRcountry")})


def _meta_issues(editor: str) -> Column:
    """Issues of a document's metadata, from the columns of _with_meta()."""
    of_tag = lambda tag: F.col(f"__{tag}")
    found = {(level, child): F.col(f"__{level}_{child}") for level in LEVELS for child in ("FRBRuri", "FRBRthis", "FRBRauthor", "FRBRcountry")}
    issue = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), F.lit(text))
    value = lambda level, child: F.coalesce(found[level, child]["attrs"]["value"], F.lit(""))
    out = []
    for level, tag in LEVELS.items():
        uri, this = value(level, "FRBRuri"), value(level, "FRBRthis")
        out += [issue(~has_form(uri, f"{level}_uri"), f"{tag}/FRBRuri has a wrong form"), issue(~has_form(this, f"{level}_this"), f"{tag}/FRBRthis has a wrong form")]
        out.append(issue((uri != "") & (this != "") & (this != F.concat(uri, F.lit("/!main"))), f"{tag}/FRBRthis is not FRBRuri and /!main"))
        author, (href, role) = found[level, "FRBRauthor"], (f"#{editor}", "#editor") if level == "mani" else AUTHORS[level]
        out.append(issue(author.isNull(), f"{tag}/FRBRauthor is missing"))
        for name, wanted in (("href", href), ("as", role)):
            out.append(F.when(author.isNotNull(), issue(author["attrs"][name] != wanted, f"{tag}/FRBRauthor@{name} is not {wanted}")))
    out.append(issue(found["work", "FRBRcountry"]["attrs"]["value"] != "un", "FRBRcountry is not un"))
    for tag in ("identification", "references"):
        el = of_tag(tag)
        out += [issue(el.isNull(), f"{tag} is missing"), F.when(el.isNotNull(), issue(el["attrs"]["source"] != "#wipo", f"{tag}@source is not #wipo"))]
    out.append(issue(of_tag("publication").isNull(), "publication is missing"))
    return F.array_compact(F.array(*out))


#: The columns of a node table that report() reads.
READ = ("doc", "pre", "parent", "tag", "eid", "attrs")


def report(nodes: DataFrame, schema: DataFrame | None = None, editor: str = EDITOR) -> DataFrame:
    """A row per document: duplicate_eids, missing_refs, bad_defs, frbr_issues, unmarked (arrays), schema_errors, and valid.

    All lists come from one pass over the nodes, grouped by document, which was one text in memory before. A document
    is valid if all lists are empty. schema (doc, schema_errors) has what a schema processor found, if one was run; nodes
    with a column errors, as schema.marked() gives them, bring these along in the same pass.
    """
    marked = "errors" in nodes.columns
    tag, attrs = F.col("tag"), F.col("attrs")
    meta = tag.startswith("FRBR") | tag.isin("identification", "references", "publication")
    said = F.col("eid").isNotNull() | tag.isin("ref", "def", "TLCTerm") | meta | (F.col("pre") == 0)  # a document's first node stands for it
    lists = nodes.where(said | (F.size("errors") > 0) if marked else said).groupBy("doc").agg(
        F.array_sort(F.collect_list("eid")).alias("ids"),
        F.collect_set(F.when(tag == "ref", attrs["href"])).alias("refs"),
        F.collect_list(F.when(tag == "def", F.struct("pre", F.coalesce("eid", F.lit("(no-eId)")).alias("eid"), attrs["refersTo"].alias("to")))).alias("defs"),
        F.collect_set(F.when(tag == "TLCTerm", F.concat(F.lit("#"), "eid"))).alias("terms"),
        F.array_sort(F.collect_list(F.when(meta, F.struct("pre", "parent", "tag", F.struct(*[attrs[k].alias(k) for k in ("value", "href", "as", "source")]).alias("attrs"))))).alias("meta"),
        *([F.array_sort(F.flatten(F.collect_list(F.when(F.size("errors") > 0, F.col("errors"))))).alias("schema_errors")] if marked else []),
    )
    targets = F.transform(F.array_distinct("ids"), lambda x: F.concat(F.lit("#"), x))
    lists = _with_meta(lists).select(
        "doc",
        F.array_distinct(F.filter("ids", lambda x, i: (i > 0) & (x == F.get("ids", i - 1)))).alias("duplicate_eids"),
        F.array_sort(F.array_except(F.filter("refs", lambda x: x.startswith("#")), targets)).alias("missing_refs"),
        F.array_sort(F.array_distinct(F.transform(F.filter("defs", lambda x: ~F.coalesce(F.array_contains("terms", x["to"]), F.lit(False))), lambda x: x["eid"]))).alias("bad_defs"),
        _meta_issues(editor).alias("frbr_issues"),
        F.filter(F.array_distinct("ids"), lambda x: x.contains("para_unmarked")).alias("unmarked"),
        *(["schema_errors"] if marked else []),
    )
    none = F.array().cast("array<string>")
    if schema is None and not marked:
        lists = lists.withColumn("schema_errors", none)
    elif schema is not None:
        lists = lists.drop("schema_errors").join(schema.select("doc", "schema_errors"), "doc", "left").withColumn("schema_errors", F.coalesce("schema_errors", none))
    empty = [F.size(c) == 0 for c in ("duplicate_eids", "missing_refs", "bad_defs", "frbr_issues", "unmarked", "schema_errors")]
    return lists.withColumn("valid", reduce(Column.__and__, empty))


def as_json(reports: DataFrame) -> DataFrame:
    """(value): a JSON object for each report, for write.text()."""
    return reports.select(F.to_json(F.struct(*reports.columns)).alias("value"))


def console(summaries: DataFrame) -> DataFrame:
    """summary()'s row with the line to print and the exit code: 0 if all are valid."""
    line = F.format_string("%d files: %d valid, %d invalid", "total_files", "valid_files", "invalid_files")
    return summaries.select("*", line.alias("line"), F.when(F.col("invalid_files") == 0, 0).otherwise(1).alias("exit_code"))


def summary(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("total_files"), F.count_if("valid").alias("valid_files"), F.count_if(~F.col("valid")).alias("invalid_files"))
