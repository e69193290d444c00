"""Converted treaties as whole Akoma Ntoso documents: metadata, preface, preamble and body, written as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..sources import files
from .validate import AUTHORS, EDITOR

#: The parts of an id and their elements; the publication's name; who is referred to.
PARTS = {"art": "article", "para": "paragraph", "list": "list", "point": "point"}
PUBLICATION = 'name="officialPublication" showAs="WIPO publication"'
ORGANISATION = '<TLCOrganization eId="wipo" href="/ontology/organization/un/wipo" showAs="World Intellectual Property Organization"/>'


def _xml(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a value, escaped; null if a value is."""
    out, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(text), T.html_escape(values[name])]
    return F.concat(*out, F.lit(rest))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def article_xml(nodes: DataFrame) -> DataFrame:
    """(doc, seg, art, xml) of NODES: each article as an element.

    An id spells the path of its element, so that what ends behind a row follows from its path and the next row's:
    one pass over an article's rows, without a tree.
    """
    rows = nodes.groupBy("doc", "seg", "art").agg(F.array_sort(F.collect_list(F.struct("ord", "eid", "tag", "num", "text", F.split(F.coalesce("eid", "parent"), "__").alias("path")))).alias("rows"))
    names = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])

    def written(x: Column, n: Column) -> Column:
        after = F.get("rows", n + 1)
        stays = F.coalesce(F.size(after["path"]) - F.when(after["eid"].isNotNull(), 1).otherwise(0), F.lit(0))
        ended = F.reverse(F.slice(x["path"], stays + 1, F.greatest(F.size(x["path"]) - stays, F.lit(0))))
        ends = F.array_join(F.transform(ended, lambda p: F.concat(F.lit("</"), F.element_at(names, F.substring_index(p, "_", 1)), F.lit(">"))), "")
        text = _or_empty(_xml("<heading>{h}</heading>", h=F.nullif(x["text"], F.lit(""))))
        element = F.concat(_xml('<{tag} eId="{eid}">', tag=x["tag"], eid=x["eid"]), _or_empty(_xml("<num>{n}</num>", n=x["num"])), text)
        leaf = _xml("<{tag}><p>{text}</p></{tag}>", tag=x["tag"], text=_or_empty(x["text"]))
        return F.concat(F.when(x["eid"].isNull(), leaf).otherwise(element), ends)

    return rows.select("doc", "seg", "art", F.array_join(F.transform("rows", written), "").alias("xml"))


def _body(articles: Column) -> Column:
    """articles (art, container, xml) in order; a container opens where it differs from the article's before, and ends likewise."""

    def placed(a: Column, n: Column) -> Column:
        c, (kind, num, heading) = a["container"], (F.get(F.split(a["container"], " ", 3), F.lit(k)) for k in range(3))
        other = lambda at: c.isNotNull() & ~c.eqNullSafe(F.get(articles, at)["container"])
        head = _xml('<{kind} eId="{kind}_{low}"><num>{up} {num}</num>', kind=kind, low=F.lower(num), up=F.upper(kind), num=num)
        head = F.concat(head, _or_empty(_xml("<heading>{h}</heading>", h=F.nullif(heading, F.lit("")))))
        return F.concat(F.when(other(n - 1), head).otherwise(""), a["xml"], F.when(other(n + 1), _xml("</{kind}>", kind=kind)).otherwise(""))

    return F.array_join(F.transform(articles, placed), "")


def _meta(kind: Column, name: Column, date: Column, generated: Column, editor: str, editor_id: str) -> Column:
    work = T.work_iri(kind, date, name)
    expression = F.concat(work, F.lit("/eng@"), date)
    head = '<{tag}><FRBRthis value="{uri}/!main"/><FRBRuri value="{uri}"/><FRBRdate date="{date}" name="{event}"/><FRBRauthor href="{who}" as="{role}"/>'

    def level(tag: str, key: str, uri: Column, day: Column, event: str, more: Column) -> Column:
        who, role = (f"#{editor_id}", "#editor") if key == "mani" else AUTHORS[key]
        begin = _xml(head.replace("{tag}", tag).replace("{event}", event).replace("{who}", who).replace("{role}", role), uri=uri, date=day)
        return F.concat(begin, more, F.lit(f"</{tag}>"))

    more = _xml('<FRBRcountry value="un"/><FRBRsubtype value="{kind}"/><FRBRnumber value="{name}" showAs="{name}"/>', kind=kind, name=name)
    references = _xml(f'<references source="#wipo">{ORGANISATION}<TLCPerson eId="{editor_id}" href="/ontology/person/{editor_id}" showAs="{{editor}}"/></references>', editor=F.lit(editor or editor_id))
    return F.concat(
        F.lit('<meta><identification source="#wipo">'),
        level("FRBRWork", "work", work, date, "adoption", more),
        level("FRBRExpression", "expr", expression, date, "adoption", F.lit('<FRBRlanguage language="eng"/>')),
        level("FRBRManifestation", "mani", F.concat(expression, F.lit(".xml")), generated, "generation", F.lit("")),
        _xml(f'</identification><publication date="{{date}}" {PUBLICATION}/>', date=date), references, F.lit("</meta>"),
    )


def documents(found: DataFrame, nodes: DataFrame, treaties: DataFrame, generated: Column | None = None, editor: str = "", editor_id: str = EDITOR) -> DataFrame:
    """(doc, seg, short_name, date, file, xml): a document for each segment of BLOCKS found, with its articles from NODES.

    treaties (doc, short_name, kind, year). The date is found in the title and the first eight lines before the
    articles; lines that look like dates are no preamble. A segment without articles has an empty body; a document
    that treaties lacks has no row. generated: the day of the run, today if not given. editor, editor_id: who made the
    manifestation, by name and as an identifier.
    """
    line = F.when(F.col("art").isNull() & F.col("line").isNotNull(), F.struct("pos", "line"))
    heads = found.groupBy("doc", "seg").agg(F.max("seg_title").alias("title"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    within = found.where("token is not null").select("doc", "seg", "art", "container")
    body = article_xml(nodes).join(within.hint("merge"), ["doc", "seg", "art"]).groupBy("doc", "seg").agg(F.array_sort(F.collect_list(F.struct("art", "container", "xml"))).alias("articles"))
    out = heads.join(treaties.select("doc", F.col("short_name").alias("base"), F.col("kind").alias("subtype"), "year").hint("merge"), "doc").join(body.hint("merge"), ["doc", "seg"], "left")
    out = out.withColumn("short_name", C.segment_name(F.col("base"), F.col("title"), F.col("seg")))
    out = out.withColumn("date", T.date_from_text(F.concat_ws(" ", "title", F.array_join(F.slice("lines", 1, 8), " ")), F.col("year")))
    kept = F.filter(F.transform("lines", lambda x: T.normalize_space(x)), lambda x: (x != "") & ~T.looks_like_date(x))
    numbered = F.transform(kept, lambda x, n: _xml('<p eId="preamble__p_{n}">{x}</p>', n=(n + 1).cast("string"), x=x))
    preamble = F.when(F.size(kept) > 0, F.concat(F.lit("<preamble>"), F.array_join(numbered, ""), F.lit("</preamble>"))).otherwise("")
    day = F.date_format(F.current_date() if generated is None else generated, "yyyy-MM-dd")
    xml = F.concat(
        _xml('<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act name="{kind}">', kind=F.col("subtype")), _meta(F.col("subtype"), F.col("short_name"), F.col("date"), day, editor, editor_id),
        _xml("<preface><p><docTitle>{title}</docTitle></p></preface>", title=F.col("title")), preamble, F.lit("<body>"), _or_empty(_body(F.col("articles"))), F.lit("</body></act></akomaNtoso>"),
    )
    return out.select("doc", "seg", "short_name", "date", T.file_name(F.substring("date", 1, 4).cast("int"), F.col("short_name")).alias("file"), xml.alias("xml"))


def write(docs: DataFrame, path: str) -> DataFrame:
    """docs (file, xml) as files of these names below path, written where the rows are; the manifest of them."""
    return files.write(docs.select("file", F.col("xml").cast("binary").alias("content")), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml) of what write() wrote."""
    return files.contents(spark, path, "*").select(F.col("doc").alias("file"), "xml")
