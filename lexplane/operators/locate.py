"""Citations resolved to nodes, and passages of nodes, for all citations at once.

Joins here are hinted to be sort-merge joins: what documents unfold to is many times what Spark guesses from the size of
the compressed table that they come from, and a broadcast chosen by that guess would pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from . import structural

WHOLE = ("article", "section", "prov")
NUMBERED = ("paragraph", "subsection", "subparagraph", "item", "point", "level", "prov", "subprov", "indent", "alinea")


def needed(nodes: DataFrame) -> DataFrame:
    """The rows and columns of a node table that find() reads, three times: callers with many documents keep these."""
    text = F.when(F.col("tag") == "num", F.col("text")).alias("text")
    return nodes.where("eid is not null or tag = 'num'").select("doc", "pre", "post", "tag", "eid", "num", text, "owner_eid", "owner_tag")


def find(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """citations (doc, ref) with eid, empty where nothing fits.

    Both sides meet on the start of their bare number, the full rule decides. The first article, section or provision
    in document order counts, else the first other node; its sub-references, however many, then lead down from node
    to node until one is not found.
    """
    asked = citations.select("doc", "ref").distinct().withColumn("norm", C.norm_ref(F.col("ref")))
    keyed = lambda c: F.explode(F.array_distinct(F.concat(C.ref_keys(c), F.array(F.concat(F.lit("w"), F.regexp_extract(c, r"(?U)^[^\p{L}\p{N}]*[\p{L}\p{N}]*", 0))))))
    nums = nodes.where("tag = 'num' and owner_eid is not null").withColumn("cand", C.norm_ref(F.col("text"))).select("doc", "pre", "cand", "owner_eid", "owner_tag", keyed(F.col("cand")).alias("key"))
    hits = asked.withColumn("key", keyed(F.col("norm"))).join(nums.hint("merge"), ["doc", "key"]).where(C.refs_match(F.col("norm"), F.col("cand")))
    order = F.struct((~F.col("owner_tag").isin(*WHOLE)).alias("later"), F.col("pre"))
    best = hits.groupBy("doc", "ref").agg(F.min_by("owner_eid", order).alias("eid"))
    at = nodes.where("eid is not null").groupBy("doc", "eid").agg(F.min(F.struct("pre", "post")).alias("at"))
    tokens = F.transform(C.sub_refs(F.col("ref")), lambda x: C.num_token(x))
    start = best.join(at.hint("merge"), ["doc", "eid"]).select("doc", F.col("ref").alias("id"), "at.pre", "at.post", "eid", tokens.alias("tokens"))
    numbered = nodes.where(F.col("eid").isNotNull() & F.col("tag").isin(*NUMBERED) & F.col("num").isNotNull()).select("doc", "pre", "post", "eid", C.num_token(F.col("num")).alias("token"))
    found = structural.descend(start, numbered).withColumnRenamed("id", "ref")
    return citations.join(found.hint("merge"), ["doc", "ref"], "left").withColumn("eid", F.coalesce("eid", F.lit("")))


def passages(wanted: DataFrame, nodes: DataFrame, chars: int = 800) -> DataFrame:
    """wanted (doc, eid) with passage: the start of the first such node's text, empty where there is none."""
    first = nodes.where("eid is not null").groupBy("doc", "eid").agg(F.min_by("content", "pre").alias("content"))
    return wanted.join(first.hint("merge"), ["doc", "eid"], "left").withColumn("passage", F.coalesce(T.cut_passage(F.regexp_replace("content", r"^\s+", ""), chars), F.lit(""))).drop("content")


def descendants(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of nodes of a document, the second inside the first: outer (doc, pre, post), inner (doc, pre_in)."""
    return structural.contained(outer, inner)
