"""Registered queries of rules, evidence, versions, rendering and helpers: operators that need a graph or whole documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..api import Engine
from ..functions import citations as C
from ..functions import text as T
from ..operators import assemble, convert, enrich, ordered, render
from ..operators import triples as G
from ..sources import akn, facts, html
from . import rules
from .queries import _TRIPLES, _customers, _nations, _spread, _t, _treaty, query

_S = "p_size::VARCHAR"


def _graph(spark, d):
    """The graph of curated facts with a jurisdiction for each nation; some have no document, source or special article."""
    n, name, c = F.col("n_nationkey"), F.col("n_nationkey").cast("string"), F.concat
    years = c((n + 46).cast("string"), F.lit(" years pma"))
    text = F.when(n % 3 == 0, c(F.lit("Yes (Art. "), name, F.lit("(2)(b) Law)"))).when(n % 3 == 1, c(F.lit("No; struck down (s. "), name, F.lit(")"))).otherwise("Fair use")
    values = {
        "id": c(F.lit("N"), name), "name": F.col("n_name"), "source_url": F.when(n % 4 != 0, c(F.lit("http://x/"), name)).otherwise(" "), "duration_literary": years, "duration_software": years,
        "reproduction": F.lit("true"), "distribution": F.when(n % 2 == 0, "true").otherwise("false"), "communication": F.lit(" TRUE "), "rental": F.when(n % 3 == 0, "true").otherwise("no"), "translation": F.when(n % 5 != 0, "true"),
        "reproduction_article": c(F.lit("Art. "), name), "distribution_article": F.lit("-"), "communication_article": F.lit(" "), "rental_article": c(F.lit("R"), name), "translation_article": c(F.lit(" T"), name, F.lit(" ")), "private_copy_exception": text,
    }
    table = _t(spark, d, "nation").select(*[values.get(k, F.lit("x")).cast("string").alias(k) for k in facts.COLUMNS])
    docs = _t(spark, d, "nation").where("n_nationkey % 2 = 0").select(c(F.lit("N"), name).alias("code"), F.when(n % 4 == 0, "economic rights").alias("rule"), c(F.lit("doc_"), name, F.lit(".xml")).alias("path"), c(F.lit("Law "), name).alias("title"))
    return facts.triples(table, docs)


_DOC = "CASE WHEN n_nationkey % 4 = 2 OR (n_nationkey % 4 = 0 AND rule = 'economic rights') THEN {} ELSE '' END"
_RULES = "(VALUES ('copyright duration'), ('economic rights'), ('personal-use exception')) r(rule)"
_LIST = "concat_ws(', ', 'communication', CASE WHEN n_nationkey % 2 = 0 THEN 'distribution' END, CASE WHEN n_nationkey % 3 = 0 THEN 'rental' END, 'reproduction', CASE WHEN n_nationkey % 5 <> 0 THEN 'translation' END)"
_TEXT = "CASE n_nationkey % 3 WHEN 0 THEN 'Yes (Art. ' || n_nationkey || '(2)(b) Law)' WHEN 1 THEN 'No; struck down (s. ' || n_nationkey || ')' ELSE 'Fair use' END"


@query("""SELECT p, sum(n)::BIGINT AS n FROM (SELECT unnest(['rdf:type', 'legal:jurisdiction', 'legal:ruleType', 'legal:docTitle', 'legal:sourceUrl', 'legal:compliesWith', 'legal:hasRight', 'legal:hasRightDetail', 'legal:exceptionText']) AS p,
unnest([3, 3, 3, 3, CASE WHEN n_nationkey % 4 <> 0 THEN 3 ELSE 0 END, CASE WHEN 46 + n_nationkey >= 50 THEN 1 ELSE 0 END, 2 + (n_nationkey % 2 = 0)::INT + (n_nationkey % 3 = 0)::INT + (n_nationkey % 5 <> 0)::INT, 1 + (n_nationkey % 3 = 0)::INT + (n_nationkey % 5 <> 0)::INT, 1]) AS n FROM nation
UNION ALL SELECT unnest(['rdf:type', 'legal:jurisdiction', 'legal:ruleType', 'legal:docTitle']), 1) GROUP BY p HAVING sum(n) > 0""")
def facts_triples(spark, d):
    used = "rdf:type legal:jurisdiction legal:ruleType legal:docTitle legal:sourceUrl legal:compliesWith legal:hasRight legal:hasRightDetail legal:exceptionText".split()
    return _graph(spark, d).where(F.col("p").isin(used)).groupBy("p").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT n_nationkey AS n, rule, {_DOC.format("'x'")} <> '' AS has, CASE WHEN n_nationkey % 4 <> 0 THEN 'http://x/' || n_nationkey END AS url FROM nation, {_RULES}),
x AS (SELECT n, CASE rule WHEN 'copyright duration' THEN 'duration' WHEN 'economic rights' THEN 'rights' ELSE 'exception' END AS node, unnest(['legal:sourceUrl', 'legal:frbrWorkUri', 'legal:eliUri', 'legal:pointInTime', 'legal:dateInForce', 'legal:isAuthoritative']) AS p,
unnest([CASE WHEN has AND n % 3 = 0 THEN 'http://own/' || n ELSE url END, CASE WHEN has THEN '/akn/N' || n END, CASE WHEN has AND n % 5 = 0 THEN 'eli/' || n END, CASE WHEN has THEN '2020-01-01' END, CASE WHEN has THEN CASE WHEN n % 3 = 1 THEN '2019-01-01' ELSE '2020-01-01' END END, CASE WHEN has AND n % 3 = 2 THEN 'true' ELSE 'false' END]) AS o FROM d)
SELECT 'ex:N' || n || '_' || node AS s, p, o, CASE p WHEN 'legal:pointInTime' THEN 'date' WHEN 'legal:dateInForce' THEN 'date' WHEN 'legal:isAuthoritative' THEN 'boolean' ELSE 'string' END AS o_type FROM x WHERE o IS NOT NULL""")
def facts_metadata(spark, d):
    """The facts' graph with the metadata of the documents: some name their page, some an earlier date in force, some are authentic."""
    n, name, c = F.col("n_nationkey"), F.col("n_nationkey").cast("string"), F.concat
    page = F.when(n % 3 == 0, c(F.lit('<FRBRalias name="sourceUri" value="http://own/'), name, F.lit('"/>'))).when(n % 3 == 1, '<FRBRdate date="2019-01-01" name="jolux:dateEntryInForce"/>').otherwise('<FRBRauthoritative value="true"/>')
    eli = F.when(n % 5 == 0, c(F.lit('<FRBRalias name="eli" value="eli/'), name, F.lit('"/>'))).otherwise("")
    date = F.when(n % 3 == 1, '<FRBRdate date="2020-01-01" name="pointInTime"/>').otherwise('<FRBRdate date="2020-01-01" name="jolux:dateEntryInForce"/>')
    xml = c(F.lit('<akomaNtoso><act><meta><identification><FRBRWork><FRBRuri value="/akn/N'), name, F.lit('"/>'), page, eli, date, F.lit("</FRBRWork></identification></meta></act></akomaNtoso>"))
    docs = _t(spark, d, "nation").select(c(F.lit("doc_"), name, F.lit(".xml")).alias("doc"), xml.alias("xml"))
    out = facts.with_metadata(_graph(spark, d), akn.frbr(akn.nodes(docs)))
    used = "legal:sourceUrl legal:frbrWorkUri legal:eliUri legal:pointInTime legal:dateInForce legal:isAuthoritative".split()
    return out.where(F.col("p").isin(used)).select("s", "p", "o", "o_type")


@query(f"SELECT count(*)::BIGINT AS triples, count(DISTINCT s)::BIGINT AS nodes, count(*) FILTER (WHERE o_kind = 'uri')::BIGINT AS links FROM ({_TRIPLES})")
def graph_size(spark, d):
    t = G.as_set(_nations(spark, d).unionByName(_customers(spark, d)))
    return t.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("nodes"), F.count_if(F.col("o_kind") == "uri").alias("links"))


@query(_TRIPLES)
def ntriples_round_trip(spark, d):
    return G.from_ntriples(G.to_ntriples(_nations(spark, d).unionByName(_customers(spark, d))))


@query("""SELECT 'ex:N' || n_nationkey || '_rights' AS s, x."right", 'ex:N' || n_nationkey || '_right_' || x."right" AS node, x.article FROM nation,
LATERAL (SELECT 'reproduction' AS "right", 'Art. ' || n_nationkey AS article UNION ALL SELECT 'rental', 'R' || n_nationkey WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'translation', 'T' || n_nationkey WHERE n_nationkey % 5 <> 0) x""")
def right_details(spark, d):
    return G.path(_graph(spark, d), "legal:hasRightDetail", {"right": "legal:rightName", "article": "legal:articleRef"})


@query(f"""SELECT n_name AS country_name, 'N' || n_nationkey AS code, 46 + n_nationkey || ' years pma' AS text, {_DOC.format("'doc_' || n_nationkey || '.xml'").replace('rule', "''")} AS path, 'WIPO (Berne Convention)' AS treaty_name, 'Art. 7 Berne Convention' AS treaty_article,
50::BIGINT AS baseline, 46 + n_nationkey >= 50 AS compliant, (n_nationkey - 4)::BIGINT AS margin FROM nation""")
def compliance_baseline(spark, d):
    return rules.compliance(_graph(spark, d)).select("country_name", "code", "text", "path", "treaty_name", "treaty_article", "baseline", "compliant", "margin")


@query(f"""WITH a AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'copyright duration' WHEN 1 THEN 'economic rights' WHEN 2 THEN 'personal-use exception' ELSE 'moral rights' END AS rule FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Copyright protection in ' || n_name || ' lasts ' || 46 + n_nationkey || ' years pma.' WHEN 1 THEN n_name || ' grants: ' || {_LIST} || '.'
WHEN 2 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'Yes, ' || n_name || ' has' ELSE 'No, ' || n_name || ' does not have' END || ' a private-copy exception. ' || {_TEXT} ELSE '' END AS answer,
CASE c_custkey % 4 WHEN 0 THEN CASE n_nationkey WHEN 4 THEN 'life_plus_50' WHEN 24 THEN 'life_plus_70' ELSE 46 + n_nationkey || ' years pma' END WHEN 1 THEN 'list' WHEN 2 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'yes' ELSE 'no' END ELSE '' END AS value,
CASE WHEN c_custkey % 4 = 2 THEN CASE n_nationkey % 3 WHEN 0 THEN 'Art. ' || n_nationkey || '(2)(b) Law' WHEN 1 THEN 's. ' || n_nationkey ELSE '' END ELSE '' END AS article,
CASE WHEN c_custkey % 4 = 3 THEN '' ELSE {_DOC.format("'Law ' || n_nationkey")} END AS title, CASE WHEN c_custkey % 4 = 3 OR n_nationkey % 4 = 0 THEN '' ELSE 'http://x/' || n_nationkey END AS source_url FROM a""")
def evidence_all(spark, d):
    rule = F.element_at(F.array(*map(F.lit, [*rules.RULE_KEYS, "moral rights"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    asked = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"), rule.alias("rule"))
    return rules.evidence(asked, _graph(spark, d)).select("id", "answer", "value", "article", "title", "source_url")


_COUNTRIES = "(VALUES " + ", ".join(f"({n}, '{c}', '{name}')" for n, (c, name) in enumerate(rules.COUNTRIES)) + ") k(n, code, name)"


def _questions(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(n) for _, n in rules.COUNTRIES]), (F.col("c_nationkey") % len(rules.COUNTRIES) + 1).cast("int"))
    text = F.when(k % 5 == 0, F.concat(F.lit("How long does copyright last in "), name, F.lit("?"))).when(k % 5 == 1, F.concat(F.lit("Is there an exception for private copies in "), F.upper(name), F.lit("?")))
    text = text.when(k % 5 == 2, F.concat(F.lit("Who may control Rental in "), name, F.lit("?"))).when(k % 5 == 3, F.concat(F.lit("Tell me about "), name)).otherwise("What is the duration elsewhere?")
    return c.select(k.alias("id"), text.alias("question"))


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 4 THEN code ELSE 'WIPO' END AS code, CASE c_custkey % 5 WHEN 1 THEN 'personal-use exception' WHEN 2 THEN 'economic rights' WHEN 3 THEN 'economic rights' ELSE 'copyright duration' END AS rule,
CASE c_custkey % 5 WHEN 1 THEN 'exception' WHEN 2 THEN 'rights' WHEN 3 THEN 'rights' ELSE 'duration' END AS rule_key FROM customer JOIN {_COUNTRIES} ON n = c_nationkey % 9""")
def route_questions(spark, d):
    return rules.route(rules.enrich(_questions(spark, d))).select("id", "code", "rule", "rule_key")


@query(f"SELECT n + 1 AS n, code, name FROM {_COUNTRIES}")
def country_list(spark, d):
    listed = Engine(_nations(spark, d), spark.createDataFrame([], "doc string, xml string")).countries()
    return listed.withColumn("n", F.element_at(F.create_map(*[F.lit(x) for n, (c, _) in enumerate(rules.COUNTRIES) for x in (c, n + 1)]), F.col("code")))


_FIRST = {"DE": ("64", "15"), "UK": ("12", "16"), "US": ("302", "106"), "FR": ("L123-1", "L122-1"), "IT": ("25", "12"), "CH": ("29", "10"), "EU": ("1", "2"), "CA": ("6", "3"), "NZ": ("22", "16")}
_NUMS = "(VALUES " + ", ".join(f"('{c}', '{a}', '{b}')" for c, (a, b) in _FIRST.items()) + ") x(c, lasts, rights)"


@query(f"""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'art_a' WHEN 2 THEN 'art_b' WHEN 3 THEN 'art_b' ELSE '' END AS eid,
CASE c_custkey % 5 WHEN 0 THEN lasts || 'It lasts as said.' WHEN 2 THEN rights || 'All rights.' WHEN 3 THEN rights || 'All rights.' WHEN 1 THEN 'No, ' || name || ' does not have a private-copy exception. ' ELSE 'Copyright protection in WIPO (Berne Convention) lasts 50 years pma (minimum).' END AS passage,
CASE c_custkey % 5 WHEN 1 THEN 'yes_no_exception' WHEN 2 THEN 'rights_list' WHEN 3 THEN 'rights_list' ELSE 'rule_card' END AS card FROM customer JOIN {_COUNTRIES} ON n = c_nationkey % 9 JOIN {_NUMS} ON c = code""")
def ask(spark, d):
    """Questions about the countries that are known by name, answered from a graph and a document for each."""
    rows = [(c, n, "70 years pma", f"{c}.xml", f"<act><body><article eId='art_a'><num>{_FIRST[c][0]}</num><content><p>It lasts as said.</p></content></article><article eId='art_b'><num>{_FIRST[c][1]}</num><content><p>All rights.</p></content></article></body></act>") for c, n in rules.COUNTRIES]
    known = spark.createDataFrame(rows, "code string, name string, duration string, path string, xml string")
    given = {"id": F.col("code"), "name": F.col("name"), "duration_literary": F.col("duration"), "duration_software": F.col("duration"), "reproduction": F.lit("true")}
    table = known.select(*[given.get(k, F.lit("")).alias(k) for k in facts.COLUMNS])
    graph = facts.triples(table, known.select("code", F.lit(None).cast("string").alias("rule"), "path", F.lit("Law").alias("title")))
    return Engine(graph, known.select(F.col("path").alias("doc"), "xml")).ask(_questions(spark, d)).select("id", F.coalesce("eid", F.lit("")).alias("eid"), "passage", "card")


_OLD = "<act><body><article eId=\"art_1\"><num>Art. 1</num><content><p>as of {}</p></content></article></body></act>"


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey % 5 AS c, least(year(o_orderdate), 2000) AS y FROM orders) SELECT id, CASE WHEN y < 1996 THEN 'before_first' WHEN y = 1998 THEN 'missing_provision' ELSE 'resolved' END AS status,
CASE WHEN y >= 1996 THEN 'C' || c || '_' || y END AS version, CASE WHEN y < 1996 THEN '<p>Document not found.</p>' WHEN y = 1998 THEN '' ELSE '<section class="article target" id="target"><h4>Art. 1</h4><div class="content"><p>as of <mark class="highlight">' || y || '</mark></p></div></section>' END AS html, 5::BIGINT AS n_versions FROM x""")
def document_at(spark, d):
    dated = [(f"C{c}", dt.date(y, 1, 1), f"C{c}_{y}", _OLD.format(y) if y != 1998 else "<act><body/></act>") for c in range(5) for y in range(1996, 2001)]
    versions = spark.createDataFrame(dated, "code string, at date, file string, xml string")
    day = F.to_date("o_orderdate")
    targets = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("code"), day.alias("at"), F.lit("art_1").alias("eid"), F.least(F.year(day), F.lit(2000)).cast("string").alias("span"))
    engine = Engine(G.as_set(_nations(spark, d)), versions.select(F.col("file").alias("doc"), "xml"), versions.select("code", "at", "file"))
    return engine.document(targets).select("id", "status", "version", "html", "n_versions")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup'")
def version_sort(spark, d):
    return ordered.numbered(_t(spark, d, "events").where("event_type = 'signup'"), ["user_id"], ["ts", "event_id"]).select("event_id", "n")


@query("""WITH r AS (SELECT n_nationkey AS n, 'R' || n_regionkey AS code, CASE n_nationkey % 2 WHEN 0 THEN 'duration' ELSE 'rights' END AS rule, 'answer of ' || n_name AS answer, 'Art. ' || n_nationkey AS article FROM nation),
p AS (SELECT c_custkey AS id, 'R' || (c_nationkey % 7) AS code, CASE c_custkey % 3 WHEN 0 THEN 'duration' WHEN 1 THEN 'rights' ELSE 'other' END AS rule FROM customer)
SELECT id, coalesce((SELECT arg_min(answer, n) FROM r WHERE r.code = p.code AND r.rule = p.rule), (SELECT arg_min(answer, n) FROM r WHERE r.rule = p.rule), '') AS answer, coalesce((SELECT arg_min(article, n) FROM r WHERE r.code = p.code AND r.rule = p.rule), (SELECT arg_min(article, n) FROM r WHERE r.rule = p.rule), '') AS article FROM p""")
def fallback_evidence(spark, d):
    n = F.col("n_nationkey")
    records = _t(spark, d, "nation").select(n.alias("n"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("code"), F.when(n % 2 == 0, "duration").otherwise("rights").alias("rule"), F.concat(F.lit("answer of "), "n_name").alias("answer"), F.concat(F.lit("Art. "), n.cast("string")).alias("article"))
    k = F.col("c_custkey") % 3
    asked = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("R"), (F.col("c_nationkey") % 7).cast("string")).alias("code"), F.when(k == 0, "duration").when(k == 1, "rights").otherwise("other").alias("rule"))
    return rules.fallback(asked, records).select("id", "answer", "article")


@query("""WITH x AS (SELECT c_nationkey AS code, c_mktsegment AS title, min((c_custkey % 3, lpad(c_custkey::VARCHAR, 9, '0'))) AS f FROM customer WHERE c_custkey % 4 <> 0 GROUP BY ALL)
SELECT 'N' || code AS code, title, 'law_' || row_number() OVER (PARTITION BY code ORDER BY f, title) AS law FROM x""")
def law_ids(spark, d):
    k = F.col("c_custkey")
    rule = F.element_at(F.array(*map(F.lit, rules.RULE_KEYS)), (k % 3 + 1).cast("int"))
    nodes = _t(spark, d, "customer").select(F.lpad(k.cast("string"), 9, "0").alias("s"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"), rule.alias("rule"), F.when(k % 4 != 0, F.col("c_mktsegment")).otherwise("").alias("title"))
    return rules.law_ids(nodes)


@query("""SELECT n_nationkey AS id, 'SELECT ?s ?p ?o WHERE { ?s legal:jurisdiction "' || upper(substr(n_name, 1, 2)) || '" . ?s ?p ?o } ORDER BY ?s ?p' AS query FROM nation""")
def query_text(spark, d):
    code = F.concat(F.lit(" "), F.lower(F.substring("n_name", 1, 2)))
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), rules.query_text(code).alias("query"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'No passage was found that supports an answer.' ELSE 'Answer: ' || p_brand || E'\\n\\nEvidence: "' || p_name || E'"\\n\\nReference: ' || CASE p_partkey % 2 WHEN 0 THEN 'Art. ' || p_size ELSE '—' END || E'\\n\\nDocument: [' || p_type || '](x.xml)'
|| CASE p_partkey % 5 WHEN 0 THEN E'\\n\\nNote: no country was named; the treaty baseline was used.' ELSE '' END END AS text FROM part""")
def full_answer(spark, d):
    k = F.col("p_partkey")
    text = rules.full_answer(F.col("p_brand"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("\n"))), F.when(k % 2 == 0, F.concat(F.lit("Art. "), F.col("p_size").cast("string"))), F.col("p_type"), F.lit("x.xml"), F.when(k % 5 != 0, "x"))
    return _t(spark, d, "part").select(k.alias("id"), text.alias("text"))


@query("""SELECT p_partkey AS id, p_partkey % 4 = 0 AS granted, p_partkey % 3 = 0 AS yes, p_partkey % 5 > 1 AS cited, p_partkey % 2 = 0 AS by_death, 'tag' || p_size AS local, CASE p_partkey % 3 WHEN 0 THEN 'Art. ' || p_size || '(2)(b) Law' WHEN 1 THEN '28B' ELSE '' END AS article,
'Art. ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '(' || p_size || ')' ELSE '' END AS reference, '[' || p_name || '](' || p_size || '.xml)' AS link, '{"n": ' || p_size || '}' AS json, CASE p_partkey % 2 WHEN 0 THEN 'x-' || p_size || '.pdf' END AS pdf,
CASE p_partkey % 3 WHEN 0 THEN 'ex:' || p_size WHEN 1 THEN 'legal:' || p_size ELSE 'http://else/' || p_size END AS short FROM part""")
def text_helpers(spark, d):
    k, s, c = F.col("p_partkey"), F.col("p_size").cast("string"), F.concat
    copies = F.when(k % 3 == 0, c(F.lit("YES ("), F.lit("Art. "), s, F.lit("(2)(b) Law)"))).when(k % 3 == 1, "No (28B)").otherwise("none")
    iri = F.when(k % 3 == 0, c(F.lit("http://e/"), s)).when(k % 3 == 1, c(F.lit("http://legal#"), s)).otherwise(c(F.lit("http://else/"), s))
    path = F.when(k % 2 == 0, c(F.lit("data/wipo/1981_x-"), s, F.lit("_clean.xml"))).otherwise("data/france/a.xml")
    return _t(spark, d, "part").select(
        k.alias("id"), T.is_true(F.when(k % 4 == 0, " True").when(k % 4 == 1, "false").when(k % 4 == 2, "yes")).alias("granted"), T.says_yes(copies).alias("yes"), T.has_article(F.when(k % 5 == 0, " - ").when(k % 5 > 1, s)).alias("cited"),
        T.by_death(F.when(k % 2 == 0, c(s, F.lit(" years Post Mortem"))).otherwise(c(s, F.lit(" years from release")))).alias("by_death"), T.local_name(c(F.lit("{http://ns}tag"), s)).alias("local"), T.exception_article(copies).alias("article"),
        T.format_reference(c(F.lit("Art. "), s), F.when(k % 2 == 0, s)).alias("reference"), T.document_link(F.col("p_name"), c(s, F.lit(".xml"))).alias("link"), T.strip_code_fence(c(F.lit(' ```json\n{"n": '), s, F.lit("}\n``` "))).alias("json"), T.pdf_name(path).alias("pdf"),
        T.shorten(iri, {"ex": "http://e/", "legal": "http://legal#"}).alias("short"),
    )


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size || ' years after the death' ELSE p_size || ' years pma' END AS span, CASE p_partkey % 2 WHEN 0 THEN 'exclusive right to copy ' || p_name ELSE '' END AS granted FROM part""")
def passage_spans(spark, d):
    k, s, c = F.col("p_partkey"), F.col("p_size").cast("string"), F.concat
    lasts = F.when(k % 3 == 0, c(F.lit("runs for "), s, F.lit(" years after the death, and"))).when(k % 3 == 1, c(F.lit("runs 1"), s, F.lit(" months"))).otherwise("runs on")
    gives = F.when(k % 2 == 0, c(F.lit("has the exclusive right to copy "), "p_name", F.lit(". More"))).otherwise("has a right")
    return _t(spark, d, "part").select(k.alias("id"), T.duration_span(lasts, c(s, F.lit(" years pma"))).alias("span"), T.exclusive_span(gives).alias("granted"))


@query("SELECT p_partkey AS id, p_partkey % 7 IN (0, 1, 5) AS date, p_partkey % 7 IN (2, 3) AS contents, p_partkey % 7 = 4 AS editorial FROM part")
def line_kinds(spark, d):
    k, n = F.col("p_partkey") % 7, F.col("p_name")
    line = F.when(k == 0, F.concat(F.lit("Signed by "), n)).when(k == 1, "(July 1, 1999)").when(k == 2, F.concat(n, F.lit(" List of the Articles"))).when(k == 3, "Contents").when(k == 4, F.concat(F.lit("Editor’s note: "), n)).when(k == 5, F.concat(n, F.lit(" as amended on a day"))).otherwise(F.concat(F.lit("Officer "), n))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.looks_like_date(line).alias("date"), T.looks_like_contents(line).alias("contents"), T.looks_editorial(line).alias("editorial"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'chapter' WHEN 1 THEN 'part' END AS kind, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'II' END AS num, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Additional Act of ' || p_name END AS heading, CASE p_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS split,
'madrid' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-additional-act' WHEN 2 THEN '-protocol' ELSE '-part' || 4 END AS segment FROM part""")
def containers(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    c = C.container_heading(F.when(k % 3 == 0, F.concat(F.lit("Chapter "), F.col("p_size").cast("string"), F.lit(" – "), n)).when(k % 3 == 1, F.concat(F.lit("II  Additional Act of "), n)).otherwise(F.concat(F.lit("I see "), n)))
    title = F.when(k % 4 == 1, F.concat(F.lit("Additional ACT "), n)).when(k % 4 == 2, F.concat(n, F.lit(" Protocol"))).otherwise(n)
    segment = C.segment_name(F.lit("madrid"), title, F.when(k % 4 == 0, 0).otherwise(3))
    return _t(spark, d, "part").select(k.alias("id"), *[c[x].alias(x) for x in ("kind", "num", "heading", "split")], segment.alias("segment"))


@query(f"""SELECT 'part_' || p_partkey AS doc, e.seg, CASE e.seg WHEN 0 THEN 'of January 1, 1971 The States, ' || p_name || ', Article 1 Scope (1) First ' || {_S} || ': (a) one (b) two (2) Second Article 2 Terms Plain text. - bullet Preamble.' ELSE 'Article 1 Again (1) More' END AS text FROM part, (VALUES (0), (1)) e(seg)""")
def source_text(spark, d):
    return convert.source_text(_treaty(spark, d))


@query("""SELECT 'part_' || p_partkey AS doc, e.pos, replace(replace(e.line, '{n}', p_name), '{s}', p_size::VARCHAR) AS text, e.depth, e.bold AS is_bold FROM part,
(VALUES (0, 'Heading of {n}', 0, true), (1, 'Some words and bold ones', 0, false), (2, 'Item {s}', 1, false), (3, 'Deeper & deeper', 2, false), (4, 'Unclosed', 0, false), (5, 'Next {s}', 0, false)) e(pos, line, depth, bold)""")
def html_entries(spark, d):
    """Entries of well-formed and of unclosed paragraphs, in lists and out of them; tables and notes are left out."""
    n, s = F.col("p_name"), F.col("p_size").cast("string")
    text = F.concat(F.lit("<html><body><h1>T</h1><p><b>Heading of "), n, F.lit("</b></p><p>Some words and <strong>bold</strong>\n ones</p><table><tr><td><p>in a table</p></td></tr></table><ul><li><p>Item "), s, F.lit("</p><ul><p>Deeper &amp; deeper</p></ul></li></ul><p>Editor’s note: x</p><p> </p><p>Unclosed<p>Next "), s, F.lit("</body></html>"))
    found = html.entries(_spread(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), text.alias("html")))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    return found.select("doc", place.alias("pos"), "text", "depth", "is_bold")


@query("""WITH x AS (SELECT 'd' || (p_partkey % 10) AS doc, p_partkey AS pos, p_brand AS target, 'term_' || replace(lower(p_brand), '#', '-') AS term FROM part)
SELECT doc, pos, 'def_' || term || '_' || row_number() OVER (PARTITION BY doc, term ORDER BY pos) AS def_eid FROM x""")
def definition_ids(spark, d):
    return enrich.definition_ids(_defined(spark, d)).select("doc", "pos", "def_eid")


def _defined(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(F.concat(F.lit("d"), (k % 10).cast("string")).alias("doc"), k.alias("pos"), F.lit(0).alias("start"), F.lit("def").alias("kind"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.upper("p_brand")).alias("target"))


@query("""WITH x AS (SELECT 'd' || (p_partkey % 10) AS doc, 'term_' || replace(lower(p_brand), '#', '-') AS eid, p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE upper(p_brand) END AS shown FROM part)
SELECT doc, eid, CASE WHEN eid LIKE '%1' AND doc < 'd5' THEN 'known' ELSE arg_min(shown, pos) END AS shown FROM x GROUP BY doc, eid""")
def upsert_terms(spark, d):
    marked = enrich.definition_ids(_defined(spark, d))
    known = marked.where(F.col("term_eid").endswith("1") & (F.col("doc") < "d5")).select("doc", F.col("term_eid").alias("eid"), F.lit("known").alias("shown")).distinct()
    return enrich.upsert_terms(known, marked)


_WHOLE = '<article class="document"><div class="preface"><p>Law {n}</p></div><div class="level level-1"><h2>Part 1 Rights</h2><section class="article target" id="target"><h4>Art. {s}</h4><div><span class="num">(1)</span> <div class="list"><div class="intro"><p>Lead</p></div><div><span class="num">(a)</span> <div class="content"><p>one {s}</p></div></div></div></div></section></div></article>'


@query(f"SELECT p_partkey AS id, replace(replace('{_WHOLE}', '{{n}}', p_name), '{{s}}', p_size::VARCHAR) AS html FROM part")
def render_document(spark, d):
    n, s = F.col("p_name"), F.col("p_size").cast("string")
    xml = F.concat(
        F.lit("<act><meta><x>no text</x></meta><preface><p>Law "), n, F.lit('</p></preface><body><part><num>Part 1</num><heading>Rights</heading><article eId="a1"><num>Art. '), s,
        F.lit("</num><paragraph><num>(1)</num><list><intro><p>Lead</p></intro><point><num>(a)</num><content><p>one "), s, F.lit("<authorialNote><p>note</p></authorialNote></p></content></point></list></paragraph></article></part></body></act>"),
    )
    return _spread(spark, d, "part").select(F.col("p_partkey").alias("id"), render.html(xml, F.lit("a1"), F.lit(""), whole=True).alias("html"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '<section class="article target" id="target"><h4>2</h4><div class="content"><p>for <mark class="highlight">' || p_size || ' years</mark></p></div></section>' WHEN 1 THEN '' ELSE '<p>Document not found.</p>' END AS html FROM part""")
def render_by_span(spark, d):
    """A provision found by the words that it contains, where its id is unknown."""
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    xml = F.concat(F.lit('<act><body><section eId="s1"><num>1</num><content><p>other</p></content></section><section eId="s2"><num>2</num><content><p>for '), s, F.lit(" years</p></content></section></body></act>"))
    span = F.when(k == 0, F.concat(s, F.lit(" years"))).otherwise("absent")
    return _spread(spark, d, "part").select(F.col("p_partkey").alias("id"), render.html(F.when(k < 2, xml), F.lit("none"), span).alias("html"))


_FILED = [
    '<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act name="treaty"><meta><identification source="#wipo"><FRBRWork><FRBRthis value="{w}/!main"/><FRBRuri value="{w}"/><FRBRdate date="{d}" name="adoption"/><FRBRauthor href="#wipo" as="#author"/><FRBRcountry value="un"/><FRBRsubtype value="treaty"/><FRBRnumber value="{k}" showAs="{k}"/></FRBRWork>',
    '<FRBRExpression><FRBRthis value="{w}/eng@{d}/!main"/><FRBRuri value="{w}/eng@{d}"/><FRBRdate date="{d}" name="adoption"/><FRBRauthor href="#wipo" as="#author"/><FRBRlanguage language="eng"/></FRBRExpression><FRBRManifestation><FRBRthis value="{w}/eng@{d}.xml/!main"/><FRBRuri value="{w}/eng@{d}.xml"/><FRBRdate date="2020-02-03" name="generation"/>',
    f'<FRBRauthor href="{assemble.AUTHORS["mani"][0]}" as="#editor"/></FRBRManifestation></identification><publication date="{{d}}" {assemble.PUBLICATION}/><references source="#wipo">{assemble.ORGANISATION}<TLCPerson eId="{assemble.AUTHORS["mani"][0][1:]}" href="/ontology/person/{assemble.AUTHORS["mani"][0][1:]}" showAs="The Editor"/></references></meta><preface><p><docTitle>{{t}}</docTitle></p></preface>',
]
_BODIES = [
    '<preamble><p eId="preamble__p_1">The States, {n},</p><p eId="preamble__p_2">Preamble.</p></preamble><body><article eId="art_1"><num>Article 1</num><heading>Scope</heading><paragraph eId="art_1__para_1"><num>(1)</num><intro><p>First {s}:</p></intro><list eId="art_1__para_1__list_1"><point eId="art_1__para_1__list_1__point_a"><num>(a)</num><content><p>one</p></content></point><point eId="art_1__para_1__list_1__point_b"><num>(b)</num><content><p>two</p></content></point></list></paragraph><paragraph eId="art_1__para_2"><num>(2)</num><content><p>Second</p></content></paragraph></article>'
    '<article eId="art_2"><num>Article 2</num><heading>Terms</heading><paragraph eId="art_2__para_1"><intro><p>Plain text.</p></intro><list eId="art_2__para_1__list_1"><point eId="art_2__para_1__list_1__point_1"><num>-</num><content><p>bullet</p></content></point></list></paragraph></article></body></act></akomaNtoso>',
    '<body><article eId="art_1"><num>Article 1</num><heading>Again</heading><paragraph eId="art_1__para_1"><num>(1)</num><content><p>More</p></content></paragraph></article></body></act></akomaNtoso>',
]


@query(f"""WITH x AS (SELECT p_partkey, p_name, p_size, s.seg, CASE s.seg WHEN 0 THEN '1971-01-01' ELSE (1900 + p_size) || '-01-01' END AS d, CASE s.seg WHEN 0 THEN 'x' || p_size ELSE 'x' || p_size || '-additional-act' END AS k, CASE s.seg WHEN 0 THEN 'Treaty ' || p_name ELSE 'Additional Act' END AS t, CASE s.seg WHEN 0 THEN '{_BODIES[0]}' ELSE '{_BODIES[1]}' END AS body FROM part, (VALUES (0), (1)) s(seg))
SELECT 'part_' || p_partkey AS doc, seg, substr(d, 1, 4) || '_' || k || '_clean.xml' AS file, replace(replace(replace(replace(replace(replace('{"".join(_FILED)}' || body, '{{w}}', '/akn/un/act/treaty/wipo/{{d}}/{{k}}'), '{{d}}', d), '{{k}}', k), '{{t}}', t), '{{n}}', p_name), '{{s}}', p_size::VARCHAR) AS xml FROM x""")
def treaty_documents(spark, d):
    """Each treaty's segments as whole documents."""
    found = _treaty(spark, d).persist()  # the articles and the documents around them
    size = F.col("p_size")
    known = _t(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), F.concat(F.lit("x"), size.cast("string")).alias("short_name"), F.lit("treaty").alias("kind"), (size + 1900).alias("year"))
    return assemble.documents(found, convert.article_nodes(found), known, F.lit("2020-02-03").cast("date"), "The Editor").select("doc", "seg", "file", "xml")
