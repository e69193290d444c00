"""Registered queries of whole documents written and read: enrichment, schema, stored graphs, Turtle, deep citations, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Engine
from ..functions import text as T
from ..operators import convert, enrich, locate, schema, stored, temporal, turtle, validate
from ..operators import triples as G
from ..session import shared_folder
from ..sources import akn, facts, files, markup, treaties
from . import rules
from .queries import _TRIPLES, _customers, _nations, _spread, _t, _treaty, query

_NAMED = {"Paris Convention": "paris", "Rome Convention": "rome"}


def _paragraphs(spark, d):
    """An act for each part: an article with a definition across an inline element, a reference out of one and one that is not there; the references lack a source or are missing."""
    k, n, s, c = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string"), F.concat
    refs = F.when(k % 2 == 0, F.lit('<references source="#x"><TLCTerm eId="term_own" href="/t" showAs="own"/></references>')).otherwise("")
    xml = c(
        F.lit("<act><meta>"), refs, F.lit('</meta><body><article eId="art_'), s, F.lit('"><p>“<i>'), F.substring_index(n, " ", 1), F.lit("</i> "), F.substr(n, F.length(F.substring_index(n, " ", 1)) + 2), F.lit("” means a &amp; b under Article "), s,
        F.lit(' of <b>the Par</b>is Convention, not Article 99</p><p>"OWN" means it, by the Rome Convention</p></article></body></act>'),
    )
    return _spread(spark, d, "part").select(c(F.lit("part_"), k.cast("string")).alias("doc"), xml.alias("xml"))


def _enriched(spark, d):
    return enrich.enriched(markup.parts(_paragraphs(spark, d)).persist(), _NAMED, {"paris": "/akn/paris", "rome": "/akn/rome"}, DataFrame.persist)


_SLUG = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')"
_FIRST = "split_part(p_name, ' ', 1)"
_REST = "substr(p_name, length(split_part(p_name, ' ', 1)) + 2)"
_TERM = f"'<TLCTerm eId=\"term_' || {_SLUG} || '\" href=\"/ontology/term/' || {_SLUG} || '\" showAs=\"' || p_name || '\"/>'"
_OWN = "'<TLCTerm eId=\"term_own\" href=\"/ontology/term/own\" showAs=\"OWN\"/>'"


@query(f"""WITH x AS (SELECT *, {_TERM} AS term FROM part)
SELECT 'part_' || p_partkey AS doc, '<act><meta>' || CASE WHEN p_partkey % 2 = 0 THEN '<references source="#wipo"><TLCTerm eId="term_own" href="/t" showAs="own"/>' || term || '</references>' ELSE '<references source="#wipo">' || list_aggregate(list_sort([term, {_OWN}]), 'string_agg', '') || '</references>' END
|| '</meta><body><article eId="art_' || p_size || '"><p>“<def eId="def_term_' || {_SLUG} || '_1" refersTo="#term_' || {_SLUG} || '"><i>' || {_FIRST} || '</i> ' || {_REST} || '</def>” means a &amp; b under <ref href="#art_' || p_size || '">Article ' || p_size || '</ref> of <b>the <ref href="/akn/paris">Par</ref></b><ref href="/akn/paris">is Convention</ref>, not Article 99</p><p>"<def eId="def_term_own_1" refersTo="#term_own">OWN</def>" means it, by the <ref href="/akn/rome">Rome Convention</ref></p></article></body></act>' AS xml FROM x""")
def enriched_documents(spark, d):
    """Definitions and references as elements in mixed content, with terms in references that are there or made."""
    return _enriched(spark, d).select("doc", "xml")


@query("""SELECT 'part_' || p_partkey AS doc, 0 AS is_total, 1::BIGINT AS files, 2::BIGINT AS defs, 1::BIGINT AS refs_internal, 2::BIGINT AS refs_external, 0::BIGINT AS failed FROM part
UNION ALL SELECT NULL, 1, count(*)::BIGINT, (2 * count(*))::BIGINT, count(*)::BIGINT, (2 * count(*))::BIGINT, 0 FROM part""")
def enriched_totals(spark, d):
    """Counters for each document and for all, after the guard has compared texts."""
    docs = _paragraphs(spark, d)
    new = enrich.checked(_enriched(spark, d), docs.withColumn("content", F.col("xml").cast("binary")))
    return enrich.totals(new, ["defs", "refs_internal", "refs_external"]).drop("status")


@query("""WITH s AS (SELECT 'part_' || p_partkey AS doc, x.* FROM part, (VALUES (0, 2, 3, 2), (1, 1, 1, 0)) x(seg, articles, paragraphs, preamble))
SELECT doc, seg, count(*)::BIGINT AS segments, sum(articles)::BIGINT AS articles, sum(paragraphs)::BIGINT AS paragraphs, sum(preamble)::BIGINT AS preamble, (CASE WHEN grouping(doc) = 1 THEN 2 WHEN grouping(seg) = 1 THEN 1 ELSE 0 END) AS level FROM s GROUP BY ROLLUP(doc, seg)""")
def convert_totals(spark, d):
    """What conversion reports for each segment, each document and all, by one ROLLUP."""
    found = _treaty(spark, d)
    return convert.totals(convert.counters(convert.article_nodes(found), found))


@query("""SELECT 'part_' || p_partkey AS doc, CASE WHEN p_partkey % 3 = 0 THEN 'OK' ELSE 'REVERTED' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 'good ' ELSE '' END || p_name AS text FROM part""")
def reverted_documents(spark, d):
    """A third of the documents changes in markup alone, the others in much of their text: these keep the original's bytes."""
    k, c = F.col("p_partkey"), F.concat
    old = c(F.when(k % 3 == 0, "good ").otherwise(""), F.col("p_name"))
    of = lambda t: c(F.lit("<act><body><p>"), t, F.lit("</p></body></act>"))
    new = F.when(k % 3 == 0, c(F.lit("good <b>"), F.col("p_name"), F.lit("</b>"))).otherwise(F.reverse(c(F.col("p_name"), F.lit("9876543210"))))
    rows = _spread(spark, d, "part").select(c(F.lit("part_"), k.cast("string")).alias("doc"), of(old).alias("old"), of(new).alias("new"))
    found = enrich.checked(rows.select("doc", F.col("new").alias("xml"), F.lit(False).alias("broken")), rows.select("doc", F.col("old").alias("xml"), F.col("old").cast("binary").alias("content")))
    return found.select("doc", "status", markup.document_text(F.col("content").cast("string")).alias("text"))


def _shaped(spark, d):
    """A document for each part; faults by number: num behind heading, work missing, manifestation twice, a body without articles, an article without its id."""
    k, c = F.col("p_partkey"), F.concat
    core = '<FRBRthis value="a"/><FRBRuri value="a"/><FRBRdate date="d" name="n"/><FRBRauthor href="#h"/>'
    mani = f"<FRBRManifestation>{core}</FRBRManifestation>"
    article = F.when(k % 5 == 0, "<heading>h</heading><num>1</num>").otherwise("<num>1</num><heading>h</heading>")
    xml = c(
        F.lit('<akomaNtoso><act name="a"><meta><identification source="#s">'), F.when(k % 7 == 0, "").otherwise(f'<FRBRWork>{core}<FRBRcountry value="un"/></FRBRWork>'), F.lit(f'<FRBRExpression>{core}<FRBRlanguage language="eng"/></FRBRExpression>'), F.lit(mani), F.when(k % 11 == 0, mani).otherwise(""),
        F.lit("</identification></meta><body>"), F.when(k % 13 == 0, "").otherwise(c(F.lit("<article"), F.when(k % 17 == 0, "").otherwise(c(F.lit(' eId="art_'), k.cast("string"), F.lit('"'))), F.lit(">"), article, F.lit("<content><p>x</p></content></article>"))), F.lit("</body></act></akomaNtoso>"),
    )
    return akn.nodes(_spread(spark, d, "part").select(c(F.lit("part_"), k.cast("string")).alias("doc"), xml.alias("xml")), {*validate.READ, *schema.READ})


_CHILDREN = "concat_ws(' ', CASE WHEN p_partkey % 7 <> 0 THEN 'FRBRWork' END, 'FRBRExpression FRBRManifestation', CASE WHEN p_partkey % 11 = 0 THEN 'FRBRManifestation' END)"


@query(f"""WITH x AS (SELECT *, 12 + (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 6 END) + (CASE WHEN p_partkey % 11 = 0 THEN 5 ELSE 0 END) + 3 AS body FROM part)
SELECT 'part_' || p_partkey AS doc, list_sort(list_filter([
CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'identification[3]: children ' || {_CHILDREN} || ' do not fit' END, CASE WHEN p_partkey % 13 = 0 THEN 'body[' || body || ']: children  do not fit' END,
CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 5 = 0 THEN 'article[' || CASE WHEN p_partkey % 17 = 0 THEN (body + 1)::VARCHAR ELSE 'art_' || p_partkey END || ']: children heading num content do not fit' END,
CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 = 0 THEN 'article[' || (body + 1) || ']: attribute eId is missing' END], lambda e: e IS NOT NULL)) AS schema_errors,
NOT (p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0) AS fits FROM x""")
def schema_report(spark, d):
    """Misplaced, missing and repeated children, and a missing attribute."""
    out = validate.report(schema.marked(_shaped(spark, d)))
    return out.select("doc", "schema_errors", (F.size("schema_errors") == 0).alias("fits"))


def _stored(spark, d):
    return stored.store(_nations(spark, d).unionByName(_customers(spark, d)), f"lexplane_{uuid.uuid4().hex[:12]}", shared_folder(spark, "graph"), 8)


@query(f"WITH t AS ({_TRIPLES}), n AS (SELECT s FROM t WHERE p = 'memberOf' AND o < 'nation_2') SELECT t.s, t.p, t.o, row_number() OVER (PARTITION BY t.s ORDER BY t.p, t.o) AS n FROM t JOIN n ON t.s = n.s")
def stored_subgraph(spark, d):
    """Triples of some customers from a graph bucketed by subject, numbered within each subject: no shuffle above the scan."""
    graph = _stored(spark, d)
    some = G.star(graph, {"nation": "memberOf", "name": "name"}).where("nation < 'nation_2'")
    from pyspark.sql import Window

    return G.subgraph(graph, [some]).select("s", "p", "o", F.row_number().over(Window.partitionBy("s").orderBy("p", "o")).alias("n"))


@query(_TRIPLES)
def turtle_round_trip(spark, d):
    """The graph written as Turtle files and read again."""
    path = shared_folder(spark, "turtle")
    turtle.write(_nations(spark, d).unionByName(_customers(spark, d)), path)
    return turtle.read(spark, path)


@query("""SELECT 'part_' || p_partkey AS doc, 'Art. 1(' || p_size || ')(a)(ii)(B)(3) LDA' AS ref, 'e_3' AS eid FROM part UNION ALL SELECT 'part_' || p_partkey, 'Art. 1(' || p_size || ')(a)(i)(B)(3)', 'e_i' FROM part
UNION ALL SELECT 'part_' || p_partkey, 'Art. 1(' || (p_size + 1) || ')(a)', CASE WHEN p_size = 2 THEN 'e_3' ELSE 'e_2' END FROM part""")
def deep_citation(spark, d):
    """Five levels of sub-references; a way that is not there ends at the last node found, and a number deeper down is found from above."""
    s, c = F.col("p_size").cast("string"), F.concat
    more = (F.col("p_size") + 1).cast("string")
    point = lambda eid, num, inside="": f'<point eId="{eid}"><num>({num})</num>{inside}</point>'
    deep = point("e_a", "a", point("e_i", "i") + point("e_ii", "ii", point("e_B", "B", point("e_3", "3"))))
    xml = c(F.lit('<act><body><article eId="e_1"><num>Article 1</num><paragraph eId="e_p"><num>('), s, F.lit(f')</num>{deep}</paragraph><paragraph eId="e_2"><num>('), more, F.lit(")</num></paragraph></article></body></act>"))
    part = _spread(spark, d, "part").select(c(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), xml.alias("xml"), F.array(c(F.lit("Art. 1("), s, F.lit(")(a)(ii)(B)(3) LDA")), c(F.lit("Art. 1("), s, F.lit(")(a)(i)(B)(3)")), c(F.lit("Art. 1("), more, F.lit(")(a)"))).alias("refs"))
    return locate.find(part.select("doc", F.explode("refs").alias("ref")), locate.needed(akn.nodes(part.select("doc", "xml"))).persist())


@query("SELECT p_partkey AS id, 'c' || (p_partkey % 20000) AS treaty FROM part WHERE p_partkey % 20000 < 10000 UNION ALL SELECT p_partkey, 'paris' FROM part")
def many_aliases(spark, d):
    """Ten thousand names at once, of which some are parts of longer words or numbers in the texts."""
    k = (F.col("p_partkey") % 20000).cast("string")
    text = F.concat(F.lit("By the PARIS convention and the Treaty of City "), k, F.lit(", not by Treaty of City 1"), k, F.lit("x or anti-/Treaty of City 2."))
    names = {f"Treaty of City {n}": f"c{n}" for n in range(10_000)} | {"Paris Convention": "paris"}
    return enrich.alias_matches(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), names).select("id", "treaty")


@query("""SELECT 's' || s_suppkey || '_VIGENZA_' || strftime(DATE '2000-01-01' + (s_suppkey % 900)::INT, '%Y-%m-%d') || '_V' || s_suppkey || '.xml' AS file, (DATE '2000-01-01' + (s_suppkey % 900)::INT)::DATE AS at, (11 + length(s_name))::BIGINT AS length FROM supplier WHERE s_suppkey % 10 > 0
UNION ALL SELECT 's' || s_suppkey || '_ORIGINALE_V0.xml', DATE '1941-07-16', (11 + length(s_name))::BIGINT FROM supplier WHERE s_suppkey % 10 = 0""")
def listed_versions(spark, d):
    """A file for each supplier written, and the folder listed: names and lengths, no contents; '_' files and other endings are left out."""
    k, c = F.col("s_suppkey"), F.concat
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 900).cast("int")), "yyyy-MM-dd")
    name = F.when(k % 10 == 0, c(F.lit("s"), k.cast("string"), F.lit("_ORIGINALE_V0.xml"))).otherwise(c(F.lit("s"), k.cast("string"), F.lit("_VIGENZA_"), day, F.lit("_V"), k.cast("string"), F.lit(".xml")))
    rows = _t(spark, d, "supplier").select(F.explode(F.array(name, c(F.lit("_"), name), F.regexp_replace(name, "xml$", "txt"))).alias("file"), c(F.lit("<act>"), "s_name", F.lit("</act>")).cast("binary").alias("content"))
    path = shared_folder(spark, "versions")
    files.write(rows, path)
    return files.listing(spark, path, "*.xml").select("file", temporal.version_of_file(F.col("file")).alias("at"), "length")


@query("""SELECT 'd' || (p_partkey % 10) AS doc, p_partkey AS pos, 'term_' || 'stra' || 'e-' || (p_partkey % 7) AS term_eid FROM part""")
def folded_terms(spark, d):
    """Wordings that differ in case alone, with a sharp s or two, are one term, named by the first."""
    k = F.col("p_partkey")
    first = k < 71  # of every document and remainder the first wording has the sharp s
    word = F.when(first, "Straße ").when(k % 3 == 0, "STRASSE ").when(k % 3 == 1, "strasse ").otherwise("straße ")
    rows = _t(spark, d, "part").select(F.concat(F.lit("d"), (k % 10).cast("string")).alias("doc"), k.alias("pos"), F.lit(0).alias("start"), F.lit("def").alias("kind"), F.concat(word, (k % 7).cast("string")).alias("target"))
    return enrich.definition_ids(rows).select("doc", "pos", "term_eid")


@query("SELECT 'N' || n_nationkey AS id, n_name || ', \"the\" ' || n_nationkey AS name, (n_nationkey + 46) || ' years pma' AS duration_literary, CASE WHEN n_nationkey % 2 = 0 THEN 'true' END AS rental, 'Yes (s. ' || n_nationkey || '(1), (2))' AS private_copy_exception FROM nation")
def facts_csv(spark, d):
    """The curated facts' file written and read: quoted commas and quotes, missing values, identifiers with blanks around them."""
    n, name = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    values = {"id": F.concat(F.lit(" N"), name, F.lit(" ")), "name": F.concat("n_name", F.lit(', "the" '), name), "duration_literary": F.concat((n + 46).cast("string"), F.lit(" years pma")), "rental": F.when(n % 2 == 0, "true"), "private_copy_exception": F.concat(F.lit("Yes (s. "), name, F.lit("(1), (2))"))}
    path = shared_folder(spark, "facts")
    _t(spark, d, "nation").select(*[values.get(k, F.lit("x")).cast("string").alias(k) for k in facts.COLUMNS]).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return facts.read(spark, path).select(*values)


@query("SELECT 'page_' || page_id || '.html' AS file, md5(html) AS digest FROM pages WHERE html <> ''")
def html_files(spark, d):
    """Raw pages written as files and read whole, by name; files whose name begins with '_' are left out."""
    path = shared_folder(spark, "pages")
    name = F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = _t(spark, d, "pages").where("html <> ''")
    manifest = files.write(pages.select(name.alias("file"), F.col("html").cast("binary").alias("content")).unionByName(pages.select(F.concat(F.lit("_"), name).alias("file"), F.lit(b"x").alias("content"))), path)
    return files.texts(manifest, path).select(F.col("doc").alias("file"), F.md5(F.col("xml").cast("binary")).alias("digest"))


@query("SELECT 'x' || p_size AS short_name, max('/akn/x' || p_size || '/' || CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE '' END) FILTER (WHERE p_partkey % 3 > 0) AS work_uri FROM part WHERE p_partkey % 3 > 0 GROUP BY p_size")
def metadata_index(spark, d):
    """The index written as JSON lines and read: names with their work identifiers, blank ones left out."""
    path, k, s = shared_folder(spark, "index"), F.col("p_partkey"), F.concat(F.lit("x"), F.col("p_size").cast("string"))
    uri = F.when(k % 3 > 0, F.concat(F.lit("/akn/"), s, F.lit("/"), "p_name")).otherwise("")
    treaties.write_index(_t(spark, d, "part").select(F.concat(F.lit("part_"), k.cast("string")).alias("file"), s.alias("short_name"), uri.alias("work_uri")), path)
    own = spark.createDataFrame([], "doc string, work_uri string")
    return treaties.work_uris(own, treaties.read_index(spark, path)).select("short_name", "work_uri")


@query("SELECT 'C' || c_nationkey AS code, DATE '2000-01-01' + (c_custkey % 50)::INT AS at, 'f' || c_custkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50, 'f' || c_custkey) AS n FROM customer WHERE c_nationkey = 7")
def versions_sorted(spark, d):
    """One jurisdiction's versions by date, those of a day by file."""
    k = F.col("c_custkey")
    versions = _t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("code"), F.date_add(F.lit("2000-01-01").cast("date"), (k % 50).cast("int")).alias("at"), F.concat(F.lit("f"), k.cast("string")).alias("file"))
    found = Engine(_nations(spark, d), spark.createDataFrame([], "doc string, xml string"), versions).versions_of("C7")
    return found.coalesce(1).withColumn("n", F.monotonically_increasing_id() + 1)  # in the order that it came in; one jurisdiction's versions are few


@query("SELECT 'part_' || p_partkey AS doc, p_name || ' means a & b under Article ' || p_size AS text FROM part")
def document_texts(spark, d):
    """All text of preface, preamble and body in this order, whatever theirs in the document, as one line."""
    s, c = F.col("p_size").cast("string"), F.concat
    xml = c(F.lit('<a:act xmlns:a="u"><a:meta><a:x>no</a:x></a:meta><a:body><a:p>under\n  <a:b>Art</a:b>icle '), s, F.lit("</a:p></a:body><a:preamble><a:p>means a &amp; b</a:p></a:preamble><a:preface><a:p> "), F.col("p_name"), F.lit("</a:p></a:preface></a:act>"))
    return _spread(spark, d, "part").select(c(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), markup.document_text(xml).alias("text"))


@query("SELECT 'part_' || p_partkey AS doc, n, CASE n WHEN 1 THEN 'b' || p_size WHEN 2 THEN 'c' ELSE p_name END AS text FROM part, (VALUES (1), (2), (3)) x(n)")
def paragraph_order(spark, d):
    """Paragraphs of the body before those of the preamble, as terms are numbered."""
    s, c = F.col("p_size").cast("string"), F.concat
    xml = c(F.lit("<act><preamble><p>"), F.col("p_name"), F.lit("</p></preamble><body><p>b<i>"), s, F.lit("</i></p><p>c</p></body></act>"))
    found = markup.parts(_spread(spark, d, "part").select(c(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), xml.alias("xml")), ["doc", "pos", "text"], {"p"})
    from ..operators import ordered

    return ordered.numbered(found, ["doc"], ["pos"]).select("doc", "n", "text")


@query("""SELECT p_partkey AS id, '"' || CASE WHEN p_partkey % 3 = 0 THEN 'lasts <u>' || p_size || ' years</u> or ' || p_size || ' years ' ELSE 'lasts ' || p_size || ' years or ' || p_size || ' years ' END || p_name || '"' AS text FROM part""")
def underlined(spark, d):
    """Evidence in quotes with the span that supports it underlined once, where it is there."""
    s = F.col("p_size").cast("string")
    passage = F.concat(F.lit(" lasts  "), s, F.lit(" years or\n"), s, F.lit(" years "), "p_name")
    span = F.when(F.col("p_partkey") % 3 == 0, F.concat(s, F.lit(" years"))).when(F.col("p_partkey") % 3 == 1, "never").otherwise("")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.underline(passage, span).alias("text"))


@query("""WITH t AS (SELECT 'ex:N' || n_nationkey || '_duration' AS node, 'copyright duration' AS kind, 'N' || n_nationkey AS code, n_name AS name, (n_nationkey + 46) || ' years pma' AS text FROM nation),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' n' || c_nationkey END AS code, CASE WHEN c_custkey % 2 = 0 THEN 'copyright duration' ELSE 'weather' END AS rule FROM customer)
SELECT p.id, t.node, t.name, t.text FROM p JOIN t ON trim(p.code) = '' OR upper(trim(p.code)) = t.code""")
def bindings_all(spark, d):
    """Rule nodes bound by each question's pattern: unknown topics ask for durations, a blank code for all jurisdictions."""
    from .rule_queries import _graph

    k = F.col("c_custkey")
    asked = _t(spark, d, "customer").select(k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"))).alias("code"), F.when(k % 2 == 0, "copyright duration").otherwise("weather").alias("rule"))
    return rules.bindings(asked, _graph(spark, d).where("s <> 'ex:WIPO_berne_art7'")).select("id", "node", "name", "text")
