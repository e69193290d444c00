"""Turtle: graphs written with prefixes, subjects gathered, and read by statements, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The prefixes of the graph's names, and the namespace of the literals' types.
PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "legal": "http://example.org/legal#", "ipronto": "http://rhizomik.net/ontologies/2005/03/ipronto.owl#", "ex": "http://example.org/resource/"}
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Names without a prefix of the table stand as IRIs below this one.
OTHER = "urn:x:"
_LOCAL = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_-])?"
#: What statements consist of: long and short literals, IRIs, comments, types, languages, numbers, names, signs.
_TOKEN = r"(?s)\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|<[^>\s]*>|#[^\n]*|\^\^|@[A-Za-z][A-Za-z0-9-]*|[+-]?\d+(?:\.\d+)?(?![\w.:-])|(?:[\p{L}\p{N}_][\p{L}\p{N}_.-]*)?:(?:[\p{L}\p{N}_:%-](?:[\p{L}\p{N}_:%.-]*[\p{L}\p{N}_:%-])?)?|[\p{L}]+|[;,\[\]()]"


def _iri(name: Column, prefixes: dict[str, str]) -> Column:
    known = "|".join(sorted(prefixes))
    plain = name.rlike(rf"^(?:{known}):{_LOCAL}$")
    raw = name
    for c in '%<>"{}|^`\\ \n\t':  # not allowed in an IRI
        raw = F.replace(raw, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(plain, name).otherwise(F.concat(F.lit(f"<{OTHER}"), raw, F.lit(">")))


def _quoted(c: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def to_turtle(triples: DataFrame, prefixes: dict[str, str] | None = None, most: int = 1000) -> DataFrame:
    """(value): a statement for each subject, its predicates behind ';' and their objects behind ','.

    A subject with more than `most` triples is split into statements of about so many, so that none is gathered whole.
    """
    prefixes = PREFIXES if prefixes is None else prefixes
    counts = triples.groupBy("s").agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    salted = triples.join(counts, "s", "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("p", "o"), F.ceil(F.col("__n") / most)), F.lit(0)))
    typed = F.when(F.col("o_type").isin("", "string"), F.lit("")).otherwise(F.concat(F.lit("^^xsd:"), F.col("o_type")))
    o = F.when(F.col("o_kind") == "uri", _iri(F.col("o"), prefixes)).otherwise(F.concat(_quoted(F.col("o")), typed))
    arms = salted.select("s", "__part", "p", o.alias("o")).groupBy("s", "__part", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("objects"))
    p = F.when(F.col("p") == "rdf:type", "a").otherwise(_iri(F.col("p"), prefixes))
    arms = arms.groupBy("s", "__part").agg(F.array_sort(F.collect_list(F.concat_ws(" ", p, F.col("objects")))).alias("arms"))
    return arms.select(F.concat(_iri(F.col("s"), prefixes), F.lit(" "), F.array_join("arms", " ;\n    "), F.lit(" .")).alias("value"))


def write(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """A folder of Turtle files, each of which begins with the prefixes."""
    prefixes = PREFIXES if prefixes is None else prefixes
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in [*prefixes.items(), ("xsd", XSD)])

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_pydict({"value": [head]}, schema=b.schema)
                first = False
            yield b

    to_turtle(triples, prefixes).mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, whole: bool = False) -> DataFrame:
    """Triples of a folder of Turtle files. Records end where a line ends with a full stop, so that large files are split
    outside of literals; whole: each file at once, for literals in three quotes that hold such lines."""
    source = spark.read.text(path, wholetext=True) if whole else spark.read.option("lineSep", ".\n").text(path)
    return statements(source, prefixes)


def statements(records: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Triples (s, p, o, o_kind, o_type) of records (value) with one or more whole statements; prefixes names what is read.

    A record's tokens are folded in order: a state of subject, predicate and what is due next. Prefixes may stand in any
    record. Lists and blank nodes in brackets are not read; their statements are left out. Language tags are dropped.
    """
    prefixes = PREFIXES if prefixes is None else prefixes
    parts = records.select(F.explode(_cut("value")).alias("t"))
    head = F.lower(F.get("t", F.lit(0)))
    declared = parts.where(head.isin("@prefix", "prefix")).select(F.regexp_replace(F.get("t", F.lit(1)), ":$", "").alias("prefix"), F.regexp_replace(F.get("t", F.lit(2)), "[<>]", "").alias("base")).distinct()
    body = parts.where(~head.isin("@prefix", "prefix", "@base", "base") & ~F.exists("t", lambda x: x.isin("[", "]", "(", ")")))
    triple = "struct<p:string,o:string,type:string>"
    zero = F.struct(F.lit(0).alias("due"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("p"), F.array().cast(f"array<{triple}>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        state = lambda due, s=None, p=None, out=None: F.struct(F.lit(due).alias("due"), (a["s"] if s is None else s).alias("s"), (a["p"] if p is None else p).alias("p"), (a["out"] if out is None else out).alias("out"))
        last = F.element_at(a["out"], -1)
        retyped = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.struct(last["p"].alias("p"), last["o"].alias("o"), t.alias("type"))))
        return (
            F.when(t == ";", state(1))
            .when(t == ",", state(2))
            .when(t == "^^", state(3))
            .when(t.startswith("@"), state(2))
            .when(a["due"] == 0, state(1, s=t))
            .when(a["due"] == 1, state(2, p=t))
            .when(a["due"] == 3, state(2, out=retyped))
            .otherwise(state(2, out=F.concat(a["out"], F.array(F.struct(a["p"].alias("p"), t.alias("o"), F.lit(None).cast("string").alias("type"))))))
        )

    folded = body.select(F.aggregate("t", zero, step).alias("f")).select("f.s", F.explode("f.out").alias("x")).select("s", "x.*")
    # every name that has a prefix meets its base once; the tables' own names stand for the bases
    named = lambda c: F.when(c == "a", F.lit(f"<{prefixes.get('rdf', '')}type>")).otherwise(c)
    out = folded.withColumns({"s": named(F.col("s")), "p": named(F.col("p"))})
    bases = declared.groupBy().agg(F.map_from_entries(F.collect_set(F.struct("prefix", "base"))).alias("bases"))
    out = out.crossJoin(F.broadcast(bases))  # one row: files declare a handful of prefixes
    return out.select(_name("s", prefixes).alias("s"), _name("p", prefixes).alias("p"), *_object(prefixes))


def _cut(value: str) -> Column:
    """The tokens of each statement of a record, an array of arrays; statements end with '.' between tokens, directives of SPARQL with their line."""
    found = F.regexp_extract_all(value, F.lit(_TOKEN + r"|\."), F.lit(0))
    found = F.filter(found, lambda t: ~t.startswith("#"))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"))

    def step(a: Column, t: Column) -> Column:
        directive = (F.size(a["now"]) == 2) & F.lower(F.get(a["now"], F.lit(0))).isin("prefix")
        closed = F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), F.array().cast("array<string>").alias("now"))
        more = F.concat(a["now"], F.array(t))
        ended = F.struct(F.concat(a["done"], F.array(more)).alias("done"), F.array().cast("array<string>").alias("now"))
        return F.when(t == ".", closed).when(directive, ended).otherwise(F.struct(a["done"].alias("done"), more.alias("now")))

    return F.filter(F.aggregate(found, zero, step, lambda a: F.concat(a["done"], F.array(a["now"]))), lambda x: F.size(x) > 0)


def _full(c: Column) -> Column:
    """The IRI of a name: what stands in brackets, or its prefix's base and the rest."""
    prefix = F.substring_index(c, ":", 1)
    return F.when(c.startswith("<"), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(F.concat(F.element_at("bases", prefix), F.substr(c, F.length(prefix) + 2)))


def _name(column: str | Column, prefixes: dict[str, str]) -> Column:
    full = _full(F.col(column) if isinstance(column, str) else column)
    out = F.when(full.startswith(OTHER), F.url_decode(F.replace(F.substr(full, F.lit(len(OTHER) + 1)), F.lit("+"), F.lit("%2B"))))
    for short, base in prefixes.items():
        out = out.when(full.startswith(base), F.concat(F.lit(f"{short}:"), F.substr(full, F.lit(len(base) + 1))))
    return out.otherwise(full)


def _object(prefixes: dict[str, str]) -> list[Column]:
    o, kind = F.col("o"), F.col("type")
    long = o.rlike(r"^(\"\"\"|''')")
    text = F.when(long, F.substr(o, F.lit(4), F.length(o) - 6)).otherwise(F.substr(o, F.lit(2), F.length(o) - 2))
    hole = ""  # a private character stands for the escaped backslash meanwhile
    for escaped, plain in (("\\\\", hole), ('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (hole, "\\")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    quoted, number, truth = o.rlike("^[\"']"), o.rlike(r"^[+-]?\d"), o.isin("true", "false")
    literal = quoted | number | truth
    typed = F.when(number, F.when(o.contains("."), "decimal").otherwise("integer")).when(truth, "boolean").when(kind.isNull(), "string").otherwise(F.regexp_replace(_full(kind), "^" + XSD.replace(".", r"\."), ""))
    return [
        F.when(quoted, text).when(literal, o).otherwise(_name(o, prefixes)).alias("o"),
        F.when(literal, "literal").otherwise("uri").alias("o_kind"),
        F.when(literal, typed).otherwise("").alias("o_type"),
    ]
