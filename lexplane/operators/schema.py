"""Content models held against node tables: a node's children, in order, as one string that a regular expression must fit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the standard's hierarchical elements, of what stands between them, and of references' entries.
HIERARCHY = "alinea article book chapter clause crossHeading division hcontainer indent item level list paragraph part point proviso prov rule section subchapter subclause subdivision sublist subparagraph subpart subprov subrule subsection subtitle title tome transitional".split()
BLOCKS = "p block blockList foreign interstitial table tocItem ul ol toc".split()
ENTRIES = "TLCConcept TLCEvent TLCLocation TLCObject TLCOrganization TLCPerson TLCProcess TLCReference TLCRole TLCTerm activeRef attachmentOf hasAttachment jurisprudence original passiveRef".split()
_CORE = "preservation? FRBRthis FRBRuri+ FRBRalias* FRBRdate+ FRBRauthor+ componentInfo? preservation?"
_HIER = f"num? heading? subheading? (content | intro? ({' | '.join(HIERARCHY)})* wrapUp?)"

#: By element, the order of its children as the standard has it, for the elements that are read or written here.
MODELS = {
    "akomaNtoso": "(act | bill | doc | statement | judgment | amendment | amendmentList | debate | debateReport | officialGazette | documentCollection | portion)",
    "act": "meta coverPage? preface? preamble? body conclusions? attachments? components?",
    "meta": "identification publication? classification* lifecycle* workflow* analysis* temporalData* references* notes* proprietary* presentation*",
    "identification": "FRBRWork FRBRExpression FRBRManifestation FRBRItem?",
    "FRBRWork": f"{_CORE} FRBRcountry FRBRsubtype? FRBRnumber* FRBRname* FRBRprescriptive? FRBRauthoritative?",
    "FRBRExpression": f"{_CORE} FRBRversionNumber? FRBRauthoritative? FRBRmasterExpression? FRBRlanguage+ FRBRtranslation*",
    "FRBRManifestation": f"{_CORE} FRBRportion? FRBRformat?",
    "references": f"({' | '.join(ENTRIES)})*",
    "preamble": f"({' | '.join([*BLOCKS, 'recitals', 'citations', 'formula', 'container', 'preamble'])})*",
    "preface": f"({' | '.join([*BLOCKS, 'longTitle', 'formula', 'container'])})+",
    "body": f"({' | '.join(HIERARCHY)})+",
    "content": f"({' | '.join(BLOCKS)})+",
    "intro": f"({' | '.join(BLOCKS)})+",
    "wrapUp": f"({' | '.join(BLOCKS)})+",
    **dict.fromkeys(HIERARCHY, _HIER),
}
#: By element, attributes that must be there.
REQUIRED = {
    "act": ["name"], "identification": ["source"], "references": ["source"], "publication": ["date", "name", "showAs"], "FRBRthis": ["value"], "FRBRuri": ["value"], "FRBRalias": ["name", "value"],
    "FRBRdate": ["date", "name"], "FRBRauthor": ["href"], "FRBRcountry": ["value"], "FRBRlanguage": ["language"], "ref": ["href"],
    **dict.fromkeys(("TLCTerm", "TLCOrganization", "TLCPerson"), ["eId", "href", "showAs"]), **dict.fromkeys([x for x in HIERARCHY if x != "crossHeading"], ["eId"]),
}


def compiled(model: str) -> str:
    """A model as a regular expression over names that a space each follows."""
    return "^" + "".join(f"(?:{t} )" if t[0].isalpha() else t for t in re.findall(r"\w+|[()|?*+]", model)) + "$"


def _one_of(tag: Column, values: dict, otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in values.items() for x in kv]), tag), otherwise)


#: The columns of a node table that marked() reads.
READ = ("doc", "pre", "tag", "eid", "attrs", "children")


def marked(nodes: DataFrame, models: dict[str, str] | None = None, required: dict[str, list[str]] | None = None) -> DataFrame:
    """nodes with errors: of each node of a table with children, what is misplaced, missing or repeated below it, and attributes that it lacks.

    Elements without a model may hold anything. Each model is a constant pattern of the plan, held against the names that
    the reader of the tree has put beside a node.
    """
    models, required = MODELS if models is None else models, REQUIRED if required is None else required
    tag, none = F.col("tag"), F.array().cast("array<string>")
    names = F.when(F.col("children") == "", "").otherwise(F.concat("children", F.lit(" ")))
    by_pattern: dict[str, list[str]] = {}
    for name, model in models.items():
        by_pattern.setdefault(compiled(model), []).append(name)
    fits = F.lit(True)
    for pattern, tags in by_pattern.items():
        fits = F.when(tag.isin(*tags), names.rlike(pattern)).otherwise(fits)
    where = F.concat(tag, F.lit("["), F.coalesce("eid", F.col("pre").cast("string")), F.lit("]"))
    lacking = F.array_except(_one_of(tag, required, none), F.map_keys("attrs"))
    found = F.concat(
        F.when(~fits, F.array(F.concat(where, F.lit(": children "), F.col("children"), F.lit(" do not fit")))).otherwise(none),
        F.transform(lacking, lambda a: F.concat(where, F.lit(": attribute "), a, F.lit(" is missing"))),
    )
    return nodes.withColumn("errors", F.when(tag.isin(*models) | tag.isin(*required), found).otherwise(none))


def errors(nodes: DataFrame, models: dict[str, str] | None = None, required: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc, schema_errors) of each document of a node table, errors sorted: misplaced, missing or repeated children, and missing attributes.

    A node table without children meets them first in one grouping by document and node, so that no task holds more
    than one element's children.
    """
    if "children" not in nodes.columns:
        own = F.struct(F.col("pre").alias("key"), F.lit(None).cast("struct<pre:int,tag:string>").alias("child"), F.struct("tag", "eid", "attrs").alias("own"))
        child = F.struct(F.col("parent").alias("key"), F.struct("pre", "tag").alias("child"), F.lit(None).cast("struct<tag:string,eid:string,attrs:map<string,string>>").alias("own"))
        pairs = nodes.select("doc", F.explode(F.array(own, child)).alias("x")).select("doc", "x.*").where("key >= 0")
        met = pairs.groupBy("doc", F.col("key").alias("pre")).agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("child")).alias("children"))
        nodes = met.select("doc", "pre", "own.*", F.array_join(F.transform("children", lambda x: x["tag"]), " ").alias("children"))
    found = marked(nodes, models, required).where((F.size("errors") > 0) | (F.col("pre") == 0))
    return found.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("errors"))).alias("schema_errors"))
