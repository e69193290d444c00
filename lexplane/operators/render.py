"""Provisions and whole documents as HTML, a document a row, in Arrow batches."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.akn import SKIPPED, _content, _local, escape

HOLDERS = {"article", "section", "prov"}
INNER = {"paragraph", "subsection", "content", "blockList", "list"}


def _kids(el, *tags: str) -> list:
    return [c for c in el if _local(c.tag) in tags]


def _words(el) -> str:
    return " ".join(_content(el).split())


def _mark(text: str, span: str) -> str:
    html, s = escape(text), escape(span)
    return html.replace(s, f'<mark class="highlight">{s}</mark>', 1) if s else html


def is_leaf(el) -> bool:
    """A provision that holds text and no other provision."""
    return any(_local(c.tag) in INNER for c in el) and not any(_local(c.tag) in HOLDERS for c in el)


def _body(el, span: str) -> str:
    """Paragraphs, lists and content of a provision, in order."""
    out = []
    for c in el:
        tag = _local(c.tag)
        if tag in SKIPPED or tag in ("num", "heading"):
            continue
        if tag in ("paragraph", "subsection", "subparagraph", "point", "item"):
            num = " ".join(_words(n) for n in _kids(c, "num"))
            row = ' class="span-row"' if span and span in _words(c) else ""
            label = f'<span class="num">{escape(num)}</span> ' if num else ""
            out.append(f"<div{row}>{label}{_body(c, span)}</div>")
        elif tag in ("list", "blockList", "content", "intro", "listWrapUp", "listIntroduction", "wrapUp"):
            inner = _body(c, span) if len(c) else _mark(_words(c), span)
            out.append(f'<div class="{tag}">{inner}</div>')
        elif tag == "p":
            out.append(f"<p>{_mark(_words(c), span)}</p>")
    return "".join(out)


def _title(el, level: int) -> str:
    text = " ".join(_words(c) for c in _kids(el, "num", "heading"))
    return f"<h{level}>{escape(text)}</h{level}>" if text else ""


def _article(el, span: str, target: bool) -> str:
    mark = ' class="article target" id="target"' if target else ' class="article"'
    return f"<section{mark}>{_title(el, 4)}{_body(el, span)}</section>"


def _target(root, eid: str, span: str):
    """The provision around the first element with eid, else the first that contains span, else none."""
    up = {c: p for p in root.iter() for c in p}
    at = next((el for el in root.iter() if eid and el.get("eId") == eid), None)
    while at is not None and not (_local(at.tag) == "article" or _local(at.tag) in HOLDERS and is_leaf(at)):
        at = up.get(at)
    if at is None and span:
        at = next((el for el in root.iter() if _local(el.tag) in HOLDERS and is_leaf(el) and span in _words(el)), None)
    return at


def _section(el, target, span: str, depth: int) -> str:
    if _local(el.tag) in HOLDERS and is_leaf(el) or _local(el.tag) == "article":
        return _article(el, span, el is target)
    inner = "".join(_section(c, target, span, depth + 1) for c in el if _local(c.tag) not in SKIPPED | {"num", "heading"})
    return f'<div class="level level-{depth}">{_title(el, min(3, depth + 1))}{inner}</div>' if len(el) else ""


def render(xml: str | None, eid: str | None, span: str | None, whole: bool) -> str:
    if not xml:
        return "<p>Document not found.</p>"
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return f"<p>Parse error: {escape(str(e))}</p>"
    target = _target(root, eid or "", span or "")
    if not whole:
        return "" if target is None else _article(target, span or "", True)
    parts = {_local(el.tag): el for el in reversed(list(root.iter())) if _local(el.tag) in ("preface", "preamble", "body")}
    front = "".join(f'<div class="{k}"><p>{escape(_words(parts[k]))}</p></div>' for k in ("preface", "preamble") if k in parts)
    body = "".join(_section(c, target, span or "", 1) for c in parts.get("body", ()))
    return f'<article class="document">{front}{body}</article>'


def html(xml: Column, eid: Column, span: Column, whole: bool = False) -> Column:
    """HTML of the provision that eid or span names, or of the whole document with it marked."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, eids: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([render(t, e, s, whole) for t, e, s in zip(texts, eids, spans, strict=True)], dtype=object)

    return run(xml, eid, span)
