"""Definitions and references marked in paragraphs, and the similarity check that guards a change of text."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import citations as C
from ..functions import text as T
from ..functions.automaton import Names
from ..sources import markup
from .ordered import pick_spans

SPANS = S.ArrayType(S.StructType([S.StructField("start", S.LongType()), S.StructField("end", S.LongType()), S.StructField("kind", S.StringType()), S.StructField("a", S.StringType()), S.StructField("b", S.StringType())]))


def alias_matches(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """rows (id, text) with treaty: each treaty that a row names by an alias, guarded against longer words; once a treaty.

    One automaton holds all aliases and reads a text once, so that thousands cost about what a few do.
    """
    names = Names(aliases)

    @F.pandas_udf("array<string>")
    def named(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(dict.fromkeys(aliases[name] for _, _, name in names.find(t))) if t else [])

    return rows.withColumn("treaty", F.explode(named(F.col("text"))))


def spans(text: Column, aliases: dict[str, str]) -> Column:
    """All candidate spans of a text: definitions (a: term), articles (a: number, b: paragraph) and aliases (a: treaty), unpicked.

    Positions of all matches have no built-in function, hence an Arrow batch function.
    """
    define, refer = (re.compile(p.removeprefix("(?i)"), re.I) for p in (C.DEFINITION, C.REFERENCE))
    names = Names(aliases)

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        def of(t: str | None) -> list[tuple]:
            if not t:
                return []
            out = [(m.start(1), m.end(1), "def", " ".join(m[1].split()).strip("“”\""), None) for m in define.finditer(t)]
            out += [(m.start(), m.end(), "ref_internal", m[1], m[2]) for m in refer.finditer(t)]
            return [x for x in out if x[3]] + [(start, end, "ref_external", aliases[name], None) for start, end, name in names.find(t)]

        return pa.array([of(t) for t in texts.to_pylist()], to_arrow_type(SPANS))

    return find(text)


def annotate(paragraphs: DataFrame, ids: DataFrame, aliases: dict[str, str], uris: dict[str, str]) -> DataFrame:
    """paragraphs (doc, pos, text) as (doc, pos, start, end, kind, target): the spans that are marked, with href or term.

    An article counts only if its paragraph, or else itself, is among ids (doc, eid); an alias only if uris has its
    treaty. Overlapping spans are picked greedily.
    """
    found = paragraphs.select("doc", "pos", F.posexplode(spans(F.col("text"), {a: t for a, t in aliases.items() if t in uris})).alias("n", "s")).select("doc", "pos", "s.*")
    art = T.eid_of(F.col("a"))
    found = found.withColumn("art", F.when(F.col("kind") == "ref_internal", art)).withColumn("para", F.when((F.col("kind") == "ref_internal") & F.col("b").isNotNull(), T.eid_of(F.col("a"), F.col("b"))))
    known = ids.where("eid is not null").select("doc", "eid").distinct()
    found = found.join(known.select("doc", F.col("eid").alias("art"), F.lit(True).alias("has_art")).hint("merge"), ["doc", "art"], "left").join(known.select("doc", F.col("eid").alias("para"), F.lit(True).alias("has_para")).hint("merge"), ["doc", "para"], "left")
    external = F.element_at(F.create_map(*[F.lit(x) for kv in uris.items() for x in kv]), F.col("a")) if uris else F.lit(None).cast("string")
    target = F.when(F.col("kind") == "def", F.col("a")).when(F.col("kind") == "ref_external", external).when(F.col("has_para"), F.concat(F.lit("#"), "para")).when(F.col("has_art"), F.concat(F.lit("#"), "art"))
    kept = found.withColumn("target", target).where("target is not null")
    picked = kept.groupBy("doc", "pos").agg(pick_spans(F.collect_list(F.struct("start", "end", "kind", "target"))).alias("s"))
    return picked.select("doc", "pos", F.explode("s").alias("s")).select("doc", "pos", "s.*")


def definition_ids(marked: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Definitions of annotate()'s rows with term_eid and def_eid, numbered by term in document order.

    Wordings that differ in case alone, by the rules of Unicode ("Strasse" and "STRASSE", with sharp s or without), are
    one term, named by the first. known (doc, eid, shown, ord): terms that a document has; the last of a wording counts.
    """
    from .ordered import numbered

    defs = marked.where("kind = 'def'").withColumn("__known", F.lit(None).cast("string"))
    if known is not None:
        typed = [F.lit(None).cast(f.dataType).alias(f.name) for f in marked.schema if f.name not in ("doc", "pos", "start", "target")]
        terms = known.where("shown <> ''").select(F.col("doc").cast(marked.schema["doc"].dataType).alias("doc"), F.lit(-1).cast(marked.schema["pos"].dataType).alias("pos"), (-F.col("ord")).cast(marked.schema["start"].dataType).alias("start"), F.col("shown").alias("target"), *typed, F.col("eid").alias("__known"))
        defs = defs.unionByName(terms)
    same = Window.partitionBy("doc", F.collate(F.upper("target"), "UTF8_LCASE")).orderBy("pos", "start")
    named = F.concat(F.lit("term_"), F.coalesce(F.nullif(T.slug(F.first("target").over(same)), F.lit("")), F.lit("term")))
    defs = defs.withColumn("term_eid", F.coalesce(F.first("__known").over(same), named)).where("kind is not null").drop("__known")
    out = numbered(defs, ["doc", "term_eid"], ["pos", "start"], "n")
    return out.withColumn("def_eid", F.concat(F.lit("def_"), "term_eid", F.lit("_"), F.col("n").cast("string"))).drop("n")


def similarity(a: Column, b: Column) -> Column:
    """difflib's ratio of two texts in normal form: 1 for two empty ones, 0 for one."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        def of(p: str | None, q: str | None) -> float:
            if not p or not q:
                return 1.0 if not p and not q else 0.0
            return 1.0 if p == q else difflib.SequenceMatcher(None, p, q).ratio()

        return pd.Series([of(p, q) for p, q in zip(x, y, strict=True)])

    return ratio(T.for_compare(a), T.for_compare(b))


def guarded(changed: Column, original: Column, similar: Column, most: float = 1.0) -> Column:
    """The changed text, or the original where they differ by more than most percent."""
    return F.when((1 - similar) * 100 > most, original).otherwise(changed)


def similarity_bound(a: Column, b: Column) -> Column:
    """At least the similarity of two texts in normal form: twice the characters that both can share, over all of them.

    Letters and digits are counted one by one, all other characters together.
    """
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    rest = lambda x: F.length(F.translate(x, signs, ""))

    def bound(x: Column) -> Column:
        shared = F.aggregate(F.array(*map(F.lit, signs)), F.least(rest(x["a"]), rest(x["b"])), lambda n, c: n + F.least(count(x["a"], c), count(x["b"], c)))
        return F.when(x["a"] == x["b"], 1.0).otherwise(2.0 * shared / F.greatest(F.length(x["a"]) + F.length(x["b"]), F.lit(1)))

    both = F.struct(*[F.coalesce(T.for_compare(c), F.lit("")).alias(n) for c, n in ((a, "a"), (b, "b"))])
    return _bound(both, bound)  # not written out for each sign


def with_delta(df: DataFrame, before: Column, after: Column, most: float = 1.0, name: str = "delta") -> DataFrame:
    """df with how far two texts differ, in percent: equal texts are decided at once, those whose bound is beyond most by
    it, and only the rest by the exact ratio, whose function gets nulls for all others."""
    df = df.withColumns({"__before": F.coalesce(T.for_compare(before), F.lit("")), "__after": F.coalesce(T.for_compare(after), F.lit(""))})
    df = df.withColumns({"__same": F.col("__before") == F.col("__after"), "__bound": similarity_bound(F.col("__before"), F.col("__after"))})
    open_ = ~F.col("__same") & ((1 - F.col("__bound")) * 100 <= most)
    df = df.withColumns({"__before": F.when(open_, F.col("__before")), "__after": F.when(open_, F.col("__after"))}).withColumn("__ratio", similarity(F.col("__before"), F.col("__after")))
    return df.withColumn(name, (1 - F.when(open_, F.col("__ratio")).otherwise(F.col("__bound"))) * 100).drop("__before", "__after", "__bound", "__ratio", "__same")


def splice(text: Column, events: Column, marks: Column) -> Column:
    """A paragraph's XML with marks set into its text, around and within the inline elements that are there.

    events: markup.EVENTS in order. marks: array<struct<start,end,open,again,close>>, apart from each other. A mark that
    crosses an element's border is cut there, and its further pieces begin with again; one that covers what an element
    covers stands inside it. Borders of both sets are put in one order, in which tags nest, and the text between them is
    escaped.
    """
    seen = F.transform(F.coalesce(events, F.array().cast(markup.EVENTS)), lambda x, n: F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["a"].alias("a"), x["b"].alias("b"), x["tag"].alias("tag"), n.alias("seq")))
    border = lambda at, rank, order, tag: F.struct(at.alias("at"), rank.alias("rank"), F.lit(order).alias("order"), tag.alias("tag"))

    def pieces(m: Column, seen: Column) -> Column:
        s, e = m["start"].cast("long"), m["end"].cast("long")
        crossing = F.filter(seen, lambda x: (x["kind"] == 0) & (((s < x["a"]) & (x["a"] < e) & (e < x["b"])) | ((x["a"] < s) & (s < x["b"]) & (x["b"] < e))))
        cuts = F.array_sort(F.array_distinct(F.transform(crossing, lambda x: F.when(s < x["a"], x["a"]).otherwise(x["b"]))))
        cut = lambda cuts: F.transform(F.concat(F.array(s), cuts), lambda at, n: F.struct(at.alias("s"), F.coalesce(F.get(cuts, n), e).alias("e"), F.when(n == 0, m["open"]).otherwise(m["again"]).alias("open"), m["close"].alias("close")))
        return _bound(cuts, cut)

    def borders(p: Column, seen: Column) -> Column:
        s, e = p["s"], p["e"]
        last = lambda test: F.coalesce(F.array_max(F.transform(F.filter(seen, test), lambda x: x["seq"])), F.lit(-1))
        behind = last(lambda x: (x["at"] == s) & (((x["kind"] == 1) & (x["a"] < s)) | ((x["kind"] == 0) & (x["b"] >= e))))
        within = last(lambda x: (x["at"] == e) & (x["kind"] == 1) & (x["a"] > s))
        return F.array(border(s, behind * 2 + 2, 1, p["open"]), border(e, within * 2 + 2, 0, p["close"]))

    def in_order(seen: Column) -> Column:
        own = F.flatten(F.transform(F.flatten(F.transform(marks, lambda m: pieces(m, seen))), lambda p: borders(p, seen)))
        return F.array_sort(F.concat(F.transform(seen, lambda x: border(x["at"], x["seq"] * 2 + 1, 1, x["tag"])), own))

    def written(ordered: Column) -> Column:
        before = lambda n: F.coalesce(F.get(ordered, n - 1)["at"], F.lit(0).cast("long"))
        with_text = F.transform(ordered, lambda x, n: F.concat(_escaped(F.substr(text, before(n) + 1, x["at"] - before(n))), x["tag"]))
        return F.concat(F.array_join(with_text, ""), _escaped(F.substr(text, before(F.size(ordered)) + 1)))

    return _bound(_bound(seen, in_order), written)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value bound to a name: a Column that f uses several times would be worked out as often, for each element inside a function of arrays."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def enriched(parts: DataFrame, aliases: dict[str, str], uris: dict[str, str], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(doc, xml, defs, refs_internal, refs_external, broken) of markup.PARTS: definitions and references as elements,
    terms in the references, which are made where there are none.

    parts are read several times; a caller with many documents keeps them, and gives in keep how marks and definitions
    are kept (DataFrame.persist, or a table). Joins are sort-merge joins: a broadcast chosen by the size of compressed
    documents would pass through the driver. What has no marks stays as it stands. A document that is no XML stays as it
    is, with broken set.
    """
    paragraphs = parts.where("kind = 'p'").select("doc", "pos", "text")
    marked = keep(annotate(paragraphs, parts.where("kind = 'id'").select("doc", "eid"), aliases, uris))
    known = parts.where("kind = 'term'").select("doc", "eid", "shown", "ord")
    defs = keep(definition_ids(marked, known))
    terms = new_terms(known, defs)
    attr = T.html_escape
    again = F.concat(F.lit('<def refersTo="#'), attr(F.col("term_eid")), F.lit('">'))
    of_def = defs.select("doc", "pos", "start", "end", F.concat(F.lit('<def eId="'), attr(F.col("def_eid")), F.lit('" refersTo="#'), attr(F.col("term_eid")), F.lit('">')).alias("open"), again.alias("again"), F.lit("</def>").alias("close"), "kind")
    ref = F.concat(F.lit('<ref href="'), attr(F.col("target")), F.lit('">'))
    of_ref = marked.where("kind <> 'def'").select("doc", "pos", "start", "end", ref.alias("open"), ref.alias("again"), F.lit("</ref>").alias("close"), "kind")
    marks = of_def.unionByName(of_ref).groupBy("doc", "pos").agg(F.collect_list(F.struct("start", "end", "open", "again", "close")).alias("marks"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("def", "defs"), ("ref_internal", "refs_internal"), ("ref_external", "refs_external"))])
    term = F.concat(F.lit('<TLCTerm eId="'), attr(F.col("eid")), F.lit('" href="/ontology/term/'), F.coalesce(F.nullif(T.slug(F.col("shown")), F.lit("")), F.lit("term")), F.lit('" showAs="'), attr(F.col("shown")), F.lit('"/>'))
    added = terms.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(term)), "").alias("added"))
    rows = parts.where("xml is not null").join(marks.hint("merge"), ["doc", "pos"], "left").join(added.hint("merge"), "doc", "left")
    more = F.coalesce("added", F.lit(""))
    refs = lambda attrs, inner: F.concat(F.lit('<references source="#wipo"'), attrs, F.lit(">"), inner, more, F.lit("</references>"))
    xml = (
        F.when((F.col("kind") == "p") & F.col("marks").isNotNull(), splice(F.col("text"), F.col("events"), F.col("marks")))
        .when(F.col("kind") == "refs", refs(F.col("text"), F.col("xml")))
        .when(F.col("kind") == "norefs", refs(F.lit(""), F.lit("")))
        .when(F.col("kind") == "nometa", F.concat(F.lit("<meta>"), refs(F.lit(""), F.lit("")), F.lit("</meta>")))
        .otherwise(F.col("xml"))
    )
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("defs", "refs_internal", "refs_external")]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", xml.alias("xml")))), lambda x: x["xml"]), "")
    return rows.groupBy("doc").agg(joined.alias("xml"), *counts, F.bool_or(F.col("kind") == "broken").alias("broken"))


def checked(new: DataFrame, original: DataFrame, most: float = 1.0) -> DataFrame:
    """new (doc, xml, broken, ...) with content, delta and status, beside original (doc, content, xml).

    OK: the new text in UTF-8; REVERTED: the original bytes, where text changed by more than most percent; BROKEN: the
    original bytes of what is no XML.
    """
    both = new.join(original.select("doc", F.col("xml").alias("__old"), F.col("content").alias("__bytes")).hint("merge"), "doc")
    of = lambda c: F.when(F.col("broken"), F.lit("")).otherwise(markup.document_text(F.col(c)))
    both = with_delta(both, of("__old"), of("xml"), most)
    status = F.when(F.col("broken"), "BROKEN").when(F.col("delta") > most, "REVERTED").otherwise("OK")
    content = F.when(status == "OK", F.col("xml").cast("binary")).otherwise(F.col("__bytes"))
    return both.withColumn("status", status).withColumn("content", content).drop("__old", "__bytes")


def totals(files: DataFrame, counters: list[str], status: str = "status") -> DataFrame:
    """A row for each of files (doc, status, counters) and one for all, by one ROLLUP: doc (null for all), is_total, files, status, counters, failed."""
    rolled = files.rollup("doc").agg(F.grouping("doc").cast("int").alias("is_total"), F.count("*").alias("files"), F.min(status).alias(status), *[F.sum(c).alias(c) for c in counters], F.count_if(F.col(status) != "OK").alias("failed"))
    return rolled.withColumn(status, F.when(F.col("is_total") == 0, F.col(status))).where("doc is not null or is_total = 1")


def upsert_terms(terms: DataFrame, marked: DataFrame) -> DataFrame:
    """terms (doc, eid, shown) and those that definition_ids()'s rows need and that are not there; the first wording of a term is shown."""
    return terms.select("doc", "eid", "shown").union(new_terms(terms, marked))


def new_terms(terms: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc, eid, shown): what upsert_terms() adds to terms."""
    need = marked.groupBy("doc", F.col("term_eid").alias("eid")).agg(F.min_by("target", F.struct("pos", "start")).alias("shown"))
    return need.join(terms.hint("merge"), ["doc", "eid"], "left_anti").select("doc", "eid", "shown")
