"""Treaty HTML to document nodes: segments and articles by a fold over each document, ids by a fold over each article."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..sources import markup
from .ordered import list_depths

BLOCKS = "doc string, seg int, seg_title string, art int, pos int, token string, display string, heading string, container string, raw string, marker string, text string, line string, depth int"
_ARROW = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in BLOCKS.split(", ")])
NODES = "doc string, seg int, art int, ord int, eid string, parent string, tag string, num string, text string"


def blocks(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """BLOCKS for entries (doc, pos, text, depth, is_bold) and titles (doc, title).

    A row for each line: art is null before a segment's first article and after a container heading; such lines are
    preamble. The line of an article's heading has a null line. When the first article's number of a segment returns,
    a new segment starts, named by the last act heading before it. That decision depends on the state so far, so each
    document is read in order by one task; headings and markers are recognised before, as columns. A document's title is
    the first row of its stream, so that no join is needed; one without a title has no rows.
    """
    a, c, m = C.article_heading(F.col("text")), C.container_heading(F.col("text")), C.marker(F.col("text"))
    art = F.when(F.col("is_bold"), a)
    lines = entries.withColumns({"token": art["token"], "display": art["display"], "heading": art["heading"], "kind": c["kind"], "cnum": c["num"], "chead": c["heading"], "split": c["split"], "raw": m["raw"], "marker": m["token"], "rest": m["text"]})

    columns = ["doc", "title", "pos", "text", "depth", "token", "display", "heading", "kind", "cnum", "chead", "split", "raw", "marker", "rest"]
    heads = titles.where("doc is not null").select("doc", "title", F.lit(0).alias("order"))
    stream = lines.where("doc is not null").withColumn("order", F.lit(1)).unionByName(heads, allowMissingColumns=True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines sorted by document; the state begins anew with each, and holds no more than a few names."""
        doc = None
        seg = number = 0
        art_no = first = container = pending = title = seg_title = None
        for b in batches:
            out: list[tuple] = []
            for order, d, name, pos, text, depth, token, display, heading, kind, cnum, chead, split, raw, marker, rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if order == 0:
                    doc, seg, number, art_no, first, container, pending = d, 0, 0, None, None, None, None
                    title = seg_title = name
                    continue
                if d != doc:
                    continue
                if kind is not None:
                    art_no, container = None, f"{kind} {cnum} {chead}".strip()
                    pending = chead if split else pending
                    continue
                line = (None, None, None, container, None, None, None, text, 0)
                if token is not None:
                    if token == first and number:
                        seg, number, container, first = seg + 1, 0, None, None
                        seg_title, pending = pending or f"{title} Part {seg + 1}", None
                    first = token if first is None else first
                    art_no, number = number, number + 1
                    line = (token, display, heading, container, None, None, None, None, 0)
                elif art_no is not None:
                    line = (None, None, None, container, raw, marker, rest, text, depth)
                out.append((doc, seg, seg_title, art_no, pos, *line))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return stream.select("order", *columns).repartition("doc").sortWithinPartitions("doc", "order", "pos").mapInArrow(fold, BLOCKS)


def article_nodes(found: DataFrame) -> DataFrame:
    """NODES of all articles of BLOCKS: paragraphs are numbered 1, 2, ... whatever is printed, lists and points below them.

    Lettered lines that follow a numbered one become a list, as the depths of their marks tell. A point's id has its
    mark, or its number in the list; a repeated one gets _2, _3, ...
    """
    lines = found.where("art is not null").withColumn("kind", C.marker_kind(F.col("raw"), F.col("marker")))
    line = F.when(F.col("line").isNotNull(), F.struct("pos", "depth", "kind", "raw", "marker", T.normalize_space(F.col("text")).alias("text")))
    head = F.max(F.when(F.col("token").isNotNull(), F.struct("token", "display", "heading")))
    articles = lines.groupBy("doc", "seg", "art").agg(F.array_sort(F.collect_list(line)).alias("lines"), head.alias("head"))
    articles = articles.select("doc", "seg", "art", "lines", "head.*").withColumn("depths", list_depths(F.col("lines")))

    def build(frames):
        for pdf in frames:
            rows: list[tuple] = []
            for r in pdf.itertuples():
                top = f"art_{r.token}"
                out = [(top, None, "article", f"Article {r.display}", r.heading)]
                lines = [] if r.lines is None else list(r.lines)
                depths = [int(x) for x in ([] if r.depths is None else r.depths)]
                least = min((x for x in depths if x > 0), default=1)
                levels = [x and x - least + 1 for x in depths]
                paragraphs, seen, lists, unnamed = 0, {}, {}, {}
                points: dict[int, str] = {}
                at: dict[int, tuple[str, str]] = {}  # by level: parent and list
                paragraph = None
                for n, (line, level) in enumerate(zip(lines, levels, strict=True)):
                    opens = (levels[n + 1] if n + 1 < len(levels) else 0) > level
                    if level == 0 or paragraph is None:
                        paragraphs += 1
                        paragraph = f"{top}__para_{paragraphs}"
                        points, at = {}, {}
                        out.append((paragraph, top, "paragraph", line["raw"] if level == 0 else None, None))
                    if level == 0:
                        owner = paragraph
                    else:
                        parent = paragraph if level == 1 else points.get(level - 1, paragraph)
                        if at.get(level, ("",))[0] != parent:
                            lists[parent] = lists.get(parent, 0) + 1
                            at = {k: v for k, v in at.items() if k < level}
                            at[level] = (parent, f"{parent}__list_{lists[parent]}")
                            out.append((at[level][1], parent, "list", None, None))
                        inside = at[level][1]
                        name = line["marker"]
                        if not name:
                            unnamed[inside] = unnamed.get(inside, 0) + 1
                            name = str(unnamed[inside])
                        owner, again = f"{inside}__point_{name}", 2
                        while owner in seen:
                            owner, again = f"{inside}__point_{name}_{again}", again + 1
                        seen[owner] = True
                        points = {k: v for k, v in points.items() if k < level}
                        points[level] = owner
                        out.append((owner, inside, "point", line["raw"], None))
                    if line["text"] or not opens:
                        out.append((None, owner, "intro" if opens else "content", None, line["text"]))
                rows += [(r.doc, r.seg, r.art, k, *x) for k, x in enumerate(out)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in NODES.split(", ")])

    return articles.mapInPandas(build, NODES)


def counters(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, seg, articles, paragraphs, preamble): what conversion reports for each segment."""
    kept = found.where("art is null and line <> ''").where(~T.looks_like_date(F.col("line"))).select("doc", "seg", F.lit(None).cast("string").alias("tag"), F.lit(1).alias("line"))
    both = nodes.select("doc", "seg", "tag", F.lit(0).alias("line")).unionByName(kept).groupBy("doc", "seg")
    out = both.agg(F.count_if(F.col("line") == 0).alias("__nodes"), F.count_if(F.col("tag") == "article").alias("articles"), F.count_if(F.col("tag") == "paragraph").alias("paragraphs"), F.sum("line").alias("preamble"))
    return out.where("__nodes > 0").drop("__nodes")


def totals(counted: DataFrame) -> DataFrame:
    """counters() with rows for each document and for all, by one ROLLUP: level 0 is a segment, 1 a document, 2 all."""
    rolled = counted.rollup("doc", "seg").agg(F.grouping_id().alias("__id"), F.count("*").alias("segments"), *[F.sum(c).alias(c) for c in ("articles", "paragraphs", "preamble")])
    return rolled.withColumn("level", F.when(F.col("__id") == 3, 2).otherwise(F.col("__id").cast("int"))).drop("__id")


def source_text(found: DataFrame) -> DataFrame:
    """(doc, seg, text): a segment's text in order, for the similarity check."""
    line = F.coalesce("line", F.concat_ws(" ", F.lit("Article"), "display", "heading"))
    return found.groupBy("doc", "seg").agg(T.normalize_space(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), " ")).alias("text"))


def kept_text(found: DataFrame) -> DataFrame:
    """(doc, seg, text): what a segment's document must say: its title and its lines, without those that look like dates before the articles."""
    lines = found.where(F.col("art").isNotNull() | ~F.coalesce(T.looks_like_date(F.col("line")), F.lit(False)))
    heads = found.groupBy("doc", "seg").agg(F.max("seg_title").alias("title"))
    return heads.join(source_text(lines).hint("merge"), ["doc", "seg"], "left").select("doc", "seg", F.concat_ws(" ", "title", "text").alias("text"))


def faithful(docs: DataFrame, found: DataFrame, most: float = 1.0) -> DataFrame:
    """docs (doc, seg, xml) with delta, how far in percent the document's text is from the source's, and status: FAIL beyond most.

    White space is left out of the comparison, as markup stands where the source has it.
    """
    from .enrich import with_delta

    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    both = docs.join(kept_text(found).hint("merge"), ["doc", "seg"])
    both = with_delta(both, bare(F.col("text")), bare(markup.document_text(F.col("xml"))), most).drop("text")
    return both.withColumn("status", F.when(F.col("delta") > most, "FAIL").otherwise("OK"))
