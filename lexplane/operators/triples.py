"""Triples (s, p, o, o_kind, o_type), and graph patterns over them as joins and one-shuffle pivots."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["s", "p", "o", "o_kind", "o_type"]


def literal(value: Column, kind: str = "string") -> tuple[Column, str, str]:
    return value, "literal", kind


def uri(value: Column) -> tuple[Column, str, str]:
    return value, "uri", ""


def expand(df: DataFrame, subject: Column, fields: Mapping[str, tuple[Column, str, str]]) -> DataFrame:
    """A triple for each row and field whose value is not null, in one pass without a shuffle."""
    triples = [F.struct(F.lit(p).alias("p"), v.cast("string").alias("o"), F.lit(k).alias("o_kind"), F.lit(t).alias("o_type")) for p, (v, k, t) in fields.items()]
    return df.select(subject.alias("s"), F.explode(F.array(*triples)).alias("t")).select("s", "t.*").where("o is not null")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def as_set(triples: DataFrame) -> DataFrame:
    """A graph is a set: equal triples count once."""
    return triples.dropDuplicates(COLUMNS)


def star(triples: DataFrame, required: Mapping[str, str], optional: Mapping[str, str] | None = None, equal: Mapping[str, str] | None = None) -> DataFrame:
    """A row (s, one column a name) for each subject that has all required predicates.

    required and optional map column names to predicates; an optional one may be null. equal holds predicates to a
    value. Only these predicates are read, and the whole star is one aggregation instead of a join for each arm; of
    several objects the smallest stands.
    """
    optional, equal = optional or {}, equal or {}
    arms = {**required, **optional}
    used = triples.where(F.col("p").isin(sorted({*arms.values(), *equal})))
    aggregates = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in arms.items()]
    held = [F.max((F.col("p") == p) & (F.col("o") == v)).alias(f"__{n}") for n, (p, v) in enumerate(equal.items())]
    table = used.groupBy("s").agg(*aggregates, *held)
    for name in required:
        table = table.where(F.col(name).isNotNull())
    for n in range(len(equal)):
        table = table.where(F.col(f"__{n}"))
    return table.select("s", *arms)


def objects(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    """(s, name): every object of a predicate, which may have several."""
    return triples.where(F.col("p") == predicate).select("s", F.col("o").alias(name))


def path(triples: DataFrame, first: str, then: Mapping[str, str]) -> DataFrame:
    """Subjects with what the objects of first have: s, node and the columns of then."""
    return objects(triples, first, "node").join(star(triples, then).withColumnRenamed("s", "node"), "node").select("s", "node", *then)


def subgraph(triples: DataFrame, nodes: Sequence[DataFrame]) -> DataFrame:
    """All triples of the nodes (s) in any of several node sets; a node in two sets counts twice, as UNION has it."""
    return triples.join(union([n.select("s") for n in nodes]), "s").select(*COLUMNS)


def exists(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_semi")


def missing(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_anti")


def with_default(df: DataFrame, specific: DataFrame, on: Sequence[str], general: DataFrame, by: Sequence[str], value: str, default: str = "") -> DataFrame:
    """df with value: from specific by its key, else from general by its, else the default."""
    a, b = specific.withColumnRenamed(value, "__a"), general.withColumnRenamed(value, "__b")
    return df.join(a, list(on), "left").join(b, list(by), "left").withColumn(value, F.coalesce("__a", "__b", F.lit(default))).drop("__a", "__b")


def from_ntriples(lines: DataFrame, base: str = "urn:x:") -> DataFrame:
    """Triples of lines (value) of N-Triples, as to_ntriples() writes them; comments and blank lines are left out."""
    iri = rf"<{re.escape(base)}([^>]*)>"
    pattern = rf'^\s*{iri}\s+{iri}\s+(?:{iri}|"((?:[^"\\]|\\.)*)"(?:\^\^<http://www\.w3\.org/2001/XMLSchema#([^>]*)>)?)\s*\.\s*$'
    part = lambda n: F.regexp_extract("value", pattern, n)
    text, hole = part(4), "\ue000"  # a private character stands for the escaped backslash meanwhile
    for escaped, plain in (("\\\\", hole), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (hole, "\\")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    is_uri = F.col("value").rlike(rf"^\s*{iri}\s+{iri}\s+{iri}\s*\.")
    kind = F.when(is_uri, "uri").otherwise("literal")
    typed = F.when(is_uri, "").when(part(5) == "", "string").otherwise(part(5))
    return lines.where(F.col("value").rlike(pattern)).select(part(1).alias("s"), part(2).alias("p"), F.when(is_uri, part(3)).otherwise(text).alias("o"), kind.alias("o_kind"), typed.alias("o_type"))


def to_ntriples(triples: DataFrame, base: str = "urn:x:") -> DataFrame:
    """(value): a line of N-Triples for each triple, for write.text()."""
    iri = lambda c: F.concat(F.lit("<" + base), c, F.lit(">"))
    quoted = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(escaped))
    typed = F.when(F.col("o_type").isin("", "string"), F.lit("")).otherwise(F.concat(F.lit("^^<http://www.w3.org/2001/XMLSchema#"), F.col("o_type"), F.lit(">")))
    o = F.when(F.col("o_kind") == "uri", iri(F.col("o"))).otherwise(F.concat(F.lit('"'), quoted, F.lit('"'), typed))
    return triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), o, F.lit(".")).alias("value"))
