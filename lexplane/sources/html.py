"""Paragraph entries of treaty HTML, read with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_editorial, looks_like_contents, normalize_space

SCHEMA = "doc string, pos int, text string, depth int, is_bold boolean"


class _Entries(HTMLParser):
    """Collects p elements; a p that another p or a block's end follows is closed there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, int, bool]] = []
        self.title: list[str] | None = None
        self.done_title = False
        self.lists = self.tables = self.bold = 0
        self.text: list[str] | None = None
        self.bold_chars = 0

    def close_p(self) -> None:
        if self.text is not None:
            self.rows.append(("".join(self.text), self.lists, self.bold_chars, self.tables > 0))
            self.text = None

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "ul", "ol", "table", "h1", "div"):
            self.close_p()
        if tag in ("ul", "ol"):
            self.lists += 1
        elif tag == "table":
            self.tables += 1
        elif tag == "p":
            self.text, self.bold_chars = [], 0
        elif tag in ("b", "strong"):
            self.bold += 1
        elif tag == "br" and self.text is not None:
            self.text.append(" ")
        elif tag == "h1" and self.title is None:
            self.title = []

    def handle_endtag(self, tag):
        if tag in ("p", "ul", "ol", "table", "div", "body"):
            self.close_p()
        if tag in ("ul", "ol"):
            self.lists = max(0, self.lists - 1)
        elif tag == "table":
            self.tables = max(0, self.tables - 1)
        elif tag in ("b", "strong"):
            self.bold = max(0, self.bold - 1)
        elif tag == "h1":
            self.done_title = True

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)
            if self.bold:
                self.bold_chars += len(" ".join(data.split()))
        if self.title is not None and not self.done_title:
            self.title.append(data)


#: A plain tag, whose attributes, if any, have quoted values; with its name, or '/' and its name.
_TAG = re.compile(r"""<(/?[A-Za-z][A-Za-z0-9]*)(?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9-]*="[^"<>]*")*[ \t\n\r\f]*>""")
#: Elements whose content, or whose attributes' end, the parser reads in other ways.
_RAW = re.compile("</?(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)(?![a-z0-9])", re.ASCII | re.IGNORECASE)
_MATTERS = {"p", "ul", "ol", "table", "h1", "div", "b", "strong", "br", "body"}


def _rows(html: str) -> list[tuple[str, int, int, bool]]:
    """(text, lists, bold characters, in a table) of each p: as the parser has them, which is asked only for what is not plain tags and text."""
    parser = _Entries()
    pieces = _TAG.split(html)
    if _RAW.search(html) or any("<" in t for t in pieces[::2]):
        parser.feed(html)
        parser.close()
    else:
        parser.done_title = True
        for n, x in enumerate(pieces):
            if n % 2 == 0:
                if x and parser.text is not None:
                    parser.handle_data(unescape(x) if "&" in x else x)
            elif x[0] == "/":
                if (tag := x[1:].lower()) in _MATTERS:
                    parser.handle_endtag(tag)
            elif (tag := x.lower()) in _MATTERS:
                parser.handle_starttag(tag, ())
    parser.close_p()
    return parser.rows


def _one_line(text: str) -> str:
    """What functions.text.normalize_space makes of text."""
    return " ".join(text.replace("\u200b", "").split())


def entries(docs: DataFrame) -> DataFrame:
    """SCHEMA for docs (doc, html): paragraphs outside tables that are neither empty, a contents heading nor an editorial note.

    depth counts the lists around a paragraph; it is bold if bold text is at least 6 characters and 60 % of it.
    """
    schema = pa.schema([("doc", pa.string()), ("pos", pa.int32()), ("text", pa.string()), ("depth", pa.int32()), ("is_bold", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for pos, (text, depth, bold, table) in enumerate(_rows(html or "")):
                    if not table and (line := _one_line(text)):
                        rows.append((doc, pos, line, depth, bold >= 6 and bold >= 0.6 * len(" ".join(text.split()))))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    out = docs.select("doc", "html").mapInArrow(run, SCHEMA)
    return out.where(~looks_like_contents(F.col("text")) & ~looks_editorial(F.col("text")))


def title(html):
    """The first h1 as a Column, or the default title."""
    found = normalize_space(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", " "))
    return F.when(found == "", "Untitled WIPO Instrument").otherwise(found)
