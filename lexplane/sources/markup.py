"""Akoma Ntoso texts cut into parts that can be changed alone: paragraphs, references, and the text around them as it stands."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_space

#: at: characters of the paragraph's text before a tag; kind: 0 opens, 1 closes, 2 belongs to an element without text; a, b: its element's span.
EVENTS = "array<struct<at:long,kind:int,a:long,b:long,tag:string>>"
#: kind: raw, p, refs, norefs (before the end of meta), nometa (at the start of the act); rows without xml: id, term; broken: no XML.
PARTS = f"doc string, ord long, kind string, pos long, xml string, text string, events {EVENTS}, eid string, shown string"
#: Rows of a batch, and characters of the documents whose rows wait for one.
ROWS, CHARACTERS = 4096, 1 << 22
_EVENT = pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("tag", pa.string())]))
_ARROW = pa.schema([("doc", pa.string()), ("ord", pa.int64()), ("kind", pa.string()), ("pos", pa.int64()), ("xml", pa.string()), ("text", pa.string()), ("events", _EVENT), ("eid", pa.string()), ("shown", pa.string())])


def _events(data: bytes) -> list[tuple]:
    """(kind, byte, name or text, attributes) of all that a parser meets; an event's source ends where the next begins."""
    out: list[tuple] = []
    p = expat.ParserCreate()
    p.StartElementHandler = lambda name, attrs: out.append(("open", p.CurrentByteIndex, name.rsplit(":", 1)[-1], attrs))
    p.EndElementHandler = lambda name: out.append(("close", p.CurrentByteIndex, name.rsplit(":", 1)[-1], None))
    p.CharacterDataHandler = lambda text: out.append(("text", p.CurrentByteIndex, text, None))
    p.DefaultHandler = lambda _: out.append(("other", p.CurrentByteIndex, "", None))
    p.Parse(data, True)
    return [*out, ("end", len(data), "", None)]


def cut(xml: str) -> list[tuple]:
    """Rows (kind, pos, xml, text, events, eid, shown) whose xml, one after another, is the text.

    Paragraphs are the outermost p of body and preamble; pos orders those of the body before those of the preamble.
    """
    data = xml.encode("utf-8")
    try:
        events = _events(data)
    except expat.ExpatError:
        return [("broken", None, xml, None, None, None, None)]
    rows: list[tuple] = []
    raw = lambda a, b: data[a:b].decode("utf-8")
    ends = [b for _, b, _, _ in events[1:]]
    names = {e[2] for e in events if e[0] == "open"}
    mark, stack, paragraphs, refs_done = 0, [], 0, False
    inner: list[list] | None = None  # of the open paragraph: its tags, text so far, where it began
    text, begin, depth, refs = "", 0, 0, None
    opened: list[list] = []
    for (kind, at, name, attrs), end in zip(events, ends, strict=False):
        if kind == "open":
            if attrs.get("eId"):
                rows.append(("id", None, None, None, None, attrs["eId"], None))
            if name == "TLCTerm" and "references" in stack and attrs.get("eId"):
                rows.append(("term", None, None, None, None, attrs["eId"], attrs.get("showAs")))
            stack.append(name)
            if inner is not None:
                tag = [len(text), 0, len(text), None, raw(at, end)]
                inner.append(tag)
                opened.append(tag)
            elif name == "p" and ("body" in stack or "preamble" in stack):
                rows.append(("raw", None, raw(mark, end), None, None, None, None))
                inner, text, begin, depth = [], "", end, len(stack)
            elif name == "references" and stack[-2:-1] == ["meta"] and not refs_done:
                rows.append(("raw", None, raw(mark, at), None, None, None, None))
                refs = ("".join(f" {k}={quoteattr(v)}" for k, v in attrs.items() if k != "source"), end)
            elif name == "act" and "meta" not in names:
                rows += [("raw", None, raw(mark, end), None, None, None, None), ("nometa", None, "", None, None, None, None)]
                mark, names = end, names | {"meta"}
        elif kind == "close":
            if inner is not None and len(stack) == depth:
                paragraphs += 1
                where = paragraphs + (0 if "body" in stack else 1 << 40)
                for tag in inner:
                    if tag[2] == tag[3]:
                        tag[1] = 2
                rows.append(("p", where, raw(begin, at), text, [dict(zip(("at", "kind", "a", "b", "tag"), t, strict=True)) for t in inner], None, None))
                inner, mark = None, at
            elif inner is not None:
                tag = opened.pop()
                tag[3] = len(text)
                inner.append([len(text), 1, tag[2], len(text), raw(at, end)])
            elif name == "references" and refs is not None:
                rows.append(("refs", None, raw(refs[1], at) if refs[1] <= at else "", refs[0], None, None, None))
                mark, refs, refs_done = end, None, True
            elif name == "meta" and not refs_done:
                rows += [("raw", None, raw(mark, at), None, None, None, None), ("norefs", None, "", None, None, None, None)]
                mark, refs_done = at, True
            stack.pop()
        elif inner is not None and kind == "text":
            text += name
        elif inner is not None and kind == "other":
            inner.append([len(text), 2, len(text), len(text), raw(at, end)])
    return [*rows, ("raw", None, raw(mark, len(data)), None, None, None, None)]


def cut_all(batches: Iterator[pa.RecordBatch], schema: pa.Schema = _ARROW, kinds: Collection[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of all documents (doc, xml); several share a batch, as one for each costs more than its document does."""
    wanted = [_ARROW.names.index(c) for c in schema.names]

    def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in zip(wanted, schema.types, strict=True)], schema=schema)

    for b in batches:
        rows, size = [], 0
        for doc, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if xml is None:
                continue
            rows += [(doc, n, *row) for n, row in enumerate(cut(xml)) if kinds is None or row[0] in kinds]
            size += len(xml)
            if len(rows) >= ROWS or size >= CHARACTERS:
                yield from made(rows)
                rows, size = [], 0
        yield from made(rows)


def parts(docs: DataFrame, columns: Sequence[str] | None = None, kinds: Collection[str] | None = None) -> DataFrame:
    """PARTS of docs (doc, xml), or only some columns and kinds of them. A null text has none; one that is no XML is one part, broken."""
    schema = _ARROW if columns is None else pa.schema([_ARROW.field(c) for c in columns])
    types = dict(zip(_ARROW.names, PARTS.split(", "), strict=True))
    return docs.select("doc", "xml").mapInArrow(lambda batches: cut_all(batches, schema, kinds), ", ".join(types[c] for c in schema.names))


def document_text(xml: Column) -> Column:
    """The text of preface, preamble and body, in this order and a space between them, as one line; the text must be XML."""
    found = ", ' ', ".join(f"//*[local-name()='{name}']" for name in ("preface", "preamble", "body"))
    return normalize_space(F.coalesce(F.xpath_string(xml, F.lit(f"concat({found})")), F.lit("")))  # one expression: the text is parsed once
