"""Akoma Ntoso documents as node tables, and their FRBR metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subtrees that are no text of a provision; tags whose text is kept; dates' names.
SKIPPED = {"authorialNote", "meta", "identification", "references", "publication"}
TEXTS = {"num", "heading", "p", "ref", "def", "docTitle"}
IN_FORCE, AT = ("entryintoforce", "dateentryinforce", "inforce"), ("dateapplicability", "pointintime", "applicability")

SCHEMA = "doc string, pre int, post int, parent int, depth int, tag string, eid string, attrs map<string,string>, num string, text string, content string, owner_eid string, owner_tag string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, xml): whole files, by name; files whose name starts with '_' are left out. In folders file=<name> that name counts."""
    df = spark.read.text(path, wholetext=True)
    name = F.col("file").cast("string") if "file" in df.columns else F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.select(name.alias("doc"), F.col("value").alias("xml")).where(~F.col("doc").startswith("_"))


@lru_cache(maxsize=4096)
def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _content(el) -> str:
    out: list[str] = []
    todo: list = [("el", el)]
    while todo:
        kind, x = todo.pop()
        if kind == "text":
            out.append(x)
        elif _local(x.tag) not in SKIPPED:
            if x.text:
                out.append(x.text)
            for child in reversed(list(x)):
                if child.tail:
                    todo.append(("text", child.tail))
                todo.append(("el", child))
    return "".join(out)


class _Tree:
    """Columns of SCHEMA, filled as a parser reads one text after another; only those that are wanted are made.

    Pieces of text are kept with the depth of the innermost skipped element around them, so that an element's content
    is a run of pieces, without another way down.
    """

    def __init__(self, wanted: Sequence[str]):
        self.wanted = wanted
        self.clear()

    def clear(self) -> None:
        self.columns: dict[str, list] = {name: [] for name in self.wanted}
        self.rows = 0

    def read(self, doc: str, xml: str | None) -> None:
        """Adds the rows of a text in document order; none for one that is no XML. Descendants of a node have pre in (pre, post]."""
        want = set(self.wanted)
        texts, content, nums = bool(want & {"num", "text", "content"}), "content" in want, "num" in want
        pieces: list[str] = []
        inside: list[int] = []
        rows: list[list] = []
        stack: list[list] = []
        dropped = [0]  # skipped elements so far

        def opened(name: str, attrs: dict) -> None:
            tag, pre, eid = _local(name), len(rows), attrs.get("eId")
            if stack:
                up, owner, around, above = stack[-1], stack[-1][6], stack[-1][7], stack[-1][0]
                up[8].append(tag)
            else:
                owner, around, above = (None, None), -1, -1
            depth = len(stack)
            if tag in SKIPPED:
                around = depth
                dropped[0] += 1
            # pre, post, parent, tag, eid, attributes, owner, depth of the innermost skipped element, children, num, text, content, depth, pieces before, dropped before
            row = [pre, pre, above, tag, eid, attrs, (eid, tag) if eid else owner, around, [], None, None, None, depth, len(pieces), dropped[0]]
            rows.append(row)
            stack.append(row)

        def closed(name: str) -> None:
            row = stack.pop()
            row[1] = len(rows) - 1
            if not texts:
                return
            tag, begin = row[3], row[13]
            if tag in TEXTS:
                row[10] = "".join(pieces[begin:])
                if tag == "num" and stack and stack[-1][9] is None:
                    stack[-1][9] = row[10]
            if content and row[4]:
                if row[7] < row[12] and dropped[0] == row[14]:
                    row[11] = "".join(pieces[begin:])
                else:
                    row[11] = "".join(t for t, d in zip(pieces[begin:], inside[begin:], strict=True) if d < row[12])

        def text(piece: str) -> None:
            pieces.append(piece)
            inside.append(stack[-1][7])

        def unknown(name: str, parameter: bool) -> None:
            raise expat.ExpatError(f"undefined entity {name}")

        parser = expat.ParserCreate(None, "}")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.SkippedEntityHandler = opened, closed, unknown
        if texts:
            parser.CharacterDataHandler = text
        try:
            parser.Parse((xml or "").encode("utf-8"), True)
        except expat.ExpatError:
            return
        self.rows += len(rows)
        for name, values in self.columns.items():
            if name == "doc":
                values += [doc] * len(rows)
            elif name == "attrs":
                values += [[(_local(k), v) for k, v in r[5].items()] for r in rows]
            elif name == "children":
                values += [" ".join(r[8]) for r in rows]
            elif name in ("owner_eid", "owner_tag"):
                values += [r[6][name == "owner_tag"] for r in rows]
            else:
                at = _PLACES[name]
                values += [r[at] for r in rows]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        out = [_maps(c) if f.name == "attrs" else pa.array(c, f.type) for c, f in zip(self.columns.values(), schema, strict=True)]
        self.clear()
        return pa.RecordBatch.from_arrays(out, schema=schema)


_PLACES = {"pre": 0, "post": 1, "parent": 2, "tag": 3, "eid": 4, "num": 9, "text": 10, "content": 11, "depth": 12}


def _maps(rows: list[list[tuple]]) -> pa.MapArray:
    ends, keys, values = [0], [], []
    for row in rows:
        for k, v in row:
            keys.append(k)
            values.append(v)
        ends.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def nodes(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The node table of docs (doc, xml). A broken or null text has no nodes.

    columns: those of SCHEMA that the caller reads, in any order, all if not given; the others are not made. children
    has the names of a node's elements in order, with a space between them, and comes only when it is named.
    """
    kinds = dict(x.split(" ") for x in SCHEMA.split(", ")) | {"children": "string"}
    wanted = [c for c in kinds if (c != "children" if columns is None else c in columns)]
    arrow = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(c, arrow[kinds[c]]) for c in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Tree(wanted)
        for b in batches:
            for doc, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree.read(doc, xml)
                if tree.rows > 20_000:
                    yield tree.batch(schema)
            if tree.rows:
                yield tree.batch(schema)

    return docs.select("doc", "xml").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def frbr(found: DataFrame) -> DataFrame:
    """A row per document of a node table: work_uri, this, eli, source_uri, in_force, point_in_time (null where missing), authoritative.

    Dates are found by name, an Expression's applicability stands before the Work's, and where there is none the date
    in force stands for it. The first alias of a kind counts. A document's few rows meet their parents inside one row, so
    that the nodes are read once and only one shuffle is made.
    """
    value = F.col("attrs")["value"]
    level = F.when(F.col("up").isin("FRBRWork"), 0).otherwise(1)
    gathered = found.where(F.col("tag").startswith("FRBR") & F.col("doc").isNotNull()).groupBy("doc").agg(F.collect_list(F.struct("pre", "parent", "tag", "attrs")).alias("all"))
    levels = F.filter("all", lambda x: x["tag"].isin("FRBRWork", "FRBRExpression"))
    placed = F.transform("all", lambda x: x.withField("up", F.get(F.filter(levels, lambda y: y["pre"] == x["parent"]), F.lit(0))["tag"]))
    meta = gathered.select("doc", F.explode(placed).alias("m")).select("doc", "m.*").where("up is not null").withColumn("name", F.regexp_replace(F.replace(F.lower(F.coalesce(F.col("attrs")["name"], F.lit(""))), F.lit("jolux:"), F.lit("")), ":", ""))
    date = F.coalesce(F.col("attrs")["date"], value)
    first = lambda cond, out=value: F.min_by(out, F.when(cond, F.struct(level, F.col("pre"))))
    last = lambda cond, out: F.min_by(out, F.when(cond, F.struct(-level, F.col("pre"))))
    work = F.col("up") == "FRBRWork"
    out = meta.groupBy("doc").agg(
        first((F.col("tag") == "FRBRuri") & work).alias("work_uri"),
        first((F.col("tag") == "FRBRthis") & work).alias("this"),
        first((F.col("tag") == "FRBRalias") & (F.col("name") == "eli")).alias("eli"),
        first((F.col("tag") == "FRBRalias") & (F.col("name") == "sourceuri")).alias("source_uri"),
        first((F.col("tag") == "FRBRdate") & F.col("name").isin(*IN_FORCE), date).alias("in_force"),
        last((F.col("tag") == "FRBRdate") & F.col("name").isin(*AT), date).alias("at"),
        F.coalesce(F.bool_or(F.col("tag").isin("FRBRauthoritative", "FRBRprescriptive") & (F.lower(value) == "true")), F.lit(False)).alias("authoritative"),
    )
    return out.withColumn("point_in_time", F.coalesce("at", "in_force")).drop("at")


_XML = re.compile(r"[&<>\"]")


def escape(text: str) -> str:
    return _XML.sub(lambda m: {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}[m[0]], text)
