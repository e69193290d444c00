"""The registered queries: each applies an operator to the driver's tables; the SQL beside it must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..operators import convert, enrich, locate, ordered, render, temporal, validate
from ..operators import triples as G
from ..session import spread
from ..sources import akn, html, national
from . import rules

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose rows become documents or many triples each, dealt over all cores by its key."""
    df = _t(spark, d, name)
    return spread(df, df.columns[0])


def _nations(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    node = F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"))
    a = G.expand(n, node, {"rdf:type": G.uri(F.lit("Nation")), "name": G.literal(F.col("n_name")), "partOf": G.uri(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")))})
    b = G.expand(r, F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")), {"rdf:type": G.uri(F.lit("Region")), "name": G.literal(F.col("r_name"))})
    return a.unionByName(b)


def _customers(spark, d):
    c = _t(spark, d, "customer")
    return G.expand(c, F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")), {"rdf:type": G.uri(F.lit("Customer")), "name": G.literal(F.col("c_name")), "memberOf": G.uri(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))})


_TRIPLES = """
SELECT 'nation_' || n_nationkey AS s, 'rdf:type' AS p, 'Nation' AS o, 'uri' AS o_kind, '' AS o_type FROM nation
UNION ALL SELECT 'nation_' || n_nationkey, 'name', n_name, 'literal', 'string' FROM nation
UNION ALL SELECT 'nation_' || n_nationkey, 'partOf', 'region_' || n_regionkey, 'uri', '' FROM nation
UNION ALL SELECT 'region_' || r_regionkey, 'rdf:type', 'Region', 'uri', '' FROM region
UNION ALL SELECT 'region_' || r_regionkey, 'name', r_name, 'literal', 'string' FROM region
UNION ALL SELECT 'customer_' || c_custkey, 'rdf:type', 'Customer', 'uri', '' FROM customer
UNION ALL SELECT 'customer_' || c_custkey, 'name', c_name, 'literal', 'string' FROM customer
UNION ALL SELECT 'customer_' || c_custkey, 'memberOf', 'nation_' || c_nationkey, 'uri', '' FROM customer"""


@query(_TRIPLES)
def triples_expand(spark, d):
    return G.as_set(_nations(spark, d).unionByName(_customers(spark, d)))


def _part_rules(spark, d):
    p = _spread(spark, d, "part")
    years = F.concat(F.col("p_size").cast("string"), F.lit(" years pma"))
    return G.expand(p, F.concat(F.lit("part_"), F.col("p_partkey").cast("string")), {
        "rdf:type": G.uri(F.lit("ExploitationRight")), "ruleType": G.literal(F.lit("copyright duration")), "jurisdiction": G.literal(F.col("p_brand")),
        "durationLiterary": G.literal(years), "docTitle": G.literal(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))), "articleRef": G.literal(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Art. "), F.col("p_size").cast("string")))),
    })


@query("SELECT 'part_' || p_partkey AS node, p_brand AS jurisdiction, p_size || ' years pma' AS duration, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Art. ' || p_size END AS article FROM part WHERE p_partkey % 7 <> 0")
def bgp_star_duration(spark, d):
    found = G.star(_part_rules(spark, d), {"jurisdiction": "jurisdiction", "duration": "durationLiterary", "title": "docTitle"}, {"article": "articleRef"}, {"rdf:type": "ExploitationRight", "ruleType": "copyright duration"})
    return found.withColumnRenamed("s", "node")


@query("SELECT 'supplier_' || s_suppkey AS node, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Art. ' || s_nationkey END AS article FROM supplier")
def bgp_optional(spark, d):
    s = _t(spark, d, "supplier")
    t = G.expand(s, F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")), {"name": G.literal(F.col("s_name")), "articleRef": G.literal(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Art. "), F.col("s_nationkey").cast("string"))))})
    return G.star(t, {"name": "name"}, {"article": "articleRef"}).withColumnRenamed("s", "node")


def _rights(spark, d):
    c = _t(spark, d, "customer")
    return G.as_set(G.expand(c, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")), {"legal:hasRight": G.literal(F.col("c_mktsegment"))}))


@query("SELECT DISTINCT 'nation_' || n_nationkey AS node, n_name AS name, c_mktsegment AS \"right\" FROM nation JOIN customer ON c_nationkey = n_nationkey")
def bgp_multivalued_rights(spark, d):
    names = G.star(_nations(spark, d), {"name": "name"}, equal={"rdf:type": "Nation"})
    return names.join(G.objects(_rights(spark, d), "legal:hasRight", "right"), "s").select(F.col("s").alias("node"), "name", "right").orderBy("node", "right")


@query("SELECT 'nation_' || c_nationkey AS node, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS rights FROM customer GROUP BY c_nationkey")
def rights_list_agg(spark, d):
    return rules.rights_list(_rights(spark, d)).withColumnRenamed("s", "node")


@query(f"""WITH t AS ({_TRIPLES}),
n AS (SELECT s FROM t WHERE p = 'partOf' AND o = 'region_0' UNION ALL SELECT s FROM t WHERE p = 'rdf:type' AND o = 'Region' UNION ALL SELECT s FROM t WHERE p = 'memberOf' AND o = 'nation_3')
SELECT t.* FROM t JOIN n USING (s)""")
def subgraph_union(spark, d):
    t = G.as_set(_nations(spark, d).unionByName(_customers(spark, d)))
    sets = [t.where((F.col("p") == p) & (F.col("o") == o)) for p, o in (("partOf", "region_0"), ("rdf:type", "Region"), ("memberOf", "nation_3"))]
    return G.subgraph(t, sets)


@query("SELECT c_custkey AS cust FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def ask_exists(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders").select("o_custkey")
    return G.exists(c, o, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("cust"))


@query("SELECT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def no_rule(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders").select("o_custkey")
    return G.missing(c, o, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("cust"))


@query("""SELECT c_custkey AS cust, CASE WHEN c_nationkey % 2 = 0 AND c_mktsegment = 'BUILDING' THEN 'special_' || c_nationkey WHEN c_nationkey % 3 = 0 THEN 'general_' || c_nationkey ELSE '' END AS doc FROM customer""")
def doc_with_default(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    special = n.where("c_nationkey % 2 = 0").select("c_nationkey", F.lit("BUILDING").alias("c_mktsegment"), F.concat(F.lit("special_"), F.col("c_nationkey").cast("string")).alias("doc"))
    general = n.where("c_nationkey % 3 = 0").select("c_nationkey", F.concat(F.lit("general_"), F.col("c_nationkey").cast("string")).alias("doc"))
    out = G.with_default(_t(spark, d, "customer"), special, ["c_nationkey", "c_mktsegment"], general, ["c_nationkey"], "doc")
    return out.select(F.col("c_custkey").alias("cust"), "doc")


_VERDICT = "SELECT 'part_' || p_partkey AS rule_id, p_size::BIGINT AS years, 25::BIGINT AS baseline, p_size >= 25 AS compliant, p_size::BIGINT - 25 AS margin FROM part"


@query(_VERDICT)
def compliance_all(spark, d):
    found = G.star(_part_rules(spark, d), {"duration": "durationLiterary"}, equal={"ruleType": "copyright duration"})
    out = found.select(F.col("s").alias("rule_id"), T.duration_years(F.col("duration")).alias("years"))
    return rules.verdict(out, "years", F.lit(25))


@query(f"""WITH v AS ({_VERDICT}), l AS (SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT n_name AS nation, count(*)::BIGINT AS n_rules, count(*) FILTER (WHERE compliant)::BIGINT AS n_compliant, min(margin)::BIGINT AS min_margin, max(margin)::BIGINT AS max_margin
FROM l JOIN v ON rule_id = 'part_' || l_partkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""")
def compliance_summary(spark, d):
    links = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_partkey", "s_nationkey").distinct()
    rows = links.withColumn("rule_id", F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))).join(compliance_all(spark, d), "rule_id")
    rows = rows.groupBy("s_nationkey").agg(F.count("*").alias("n_rules"), F.count_if("compliant").alias("n_compliant"), F.min("margin").alias("min_margin"), F.max("margin").alias("max_margin"))
    return rows.join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("nation"), "n_rules", "n_compliant", "min_margin", "max_margin")


def _versions(spark, d):
    e = _t(spark, d, "events")
    v = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("version"), F.col("event_id").alias("ord"))
    targets = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return targets, v


_ASOF = """SELECT p.event_id, p.user_id, max_by(s.event_id, (s.ts, s.event_id)) AS version, max(s.ts) AS found FROM events p
LEFT JOIN events s ON s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY ALL"""


@query(f"SELECT event_id, version FROM ({_ASOF})")
def asof_version(spark, d):
    targets, v = _versions(spark, d)
    return temporal.asof(targets, v, "user_id", "ts", "version", "ord", F.to_date("ts")).select("event_id", "version")


@query(f"SELECT event_id, CASE WHEN version IS NULL THEN 'before_first' ELSE 'resolved' END AS status, strftime(found, '%Y-%m-%d') AS version_date FROM ({_ASOF})")
def asof_status(spark, d):
    targets, v = _versions(spark, d)
    out = temporal.asof(targets, v, "user_id", "ts", "version", "ord", F.to_date("ts"))
    return out.select("event_id", F.when(F.col("version").isNull(), "before_first").otherwise("resolved").alias("status"), F.date_format("value_at", "yyyy-MM-dd").alias("version_date"))


@query("SELECT user_id, count(*)::BIGINT AS n_versions, strftime(min(ts), '%Y-%m-%d') AS earliest, strftime(max(ts), '%Y-%m-%d') AS latest FROM events WHERE event_type = 'signup' GROUP BY user_id")
def version_range(spark, d):
    _, v = _versions(spark, d)
    return temporal.version_range(v, "user_id", "ts").select("user_id", "n_versions", F.date_format("earliest", "yyyy-MM-dd").alias("earliest"), F.date_format("latest", "yyyy-MM-dd").alias("latest"))


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'x_VIGENZA_' || strftime(o_orderdate, '%Y-%m-%d') || '_V' || (o_orderkey % 9) || '.xml' WHEN 1 THEN 'x_ORIGINALE_V0.xml' ELSE 'other.xml' END AS file, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN d WHEN 1 THEN '1941-07-16' END AS valid_from FROM f""")
def version_listing(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(k % 3 == 0, F.concat(F.lit("x_VIGENZA_"), day, F.lit("_V"), (k % 9).cast("string"), F.lit(".xml"))).when(k % 3 == 1, "x_ORIGINALE_V0.xml").otherwise("other.xml")
    return _t(spark, d, "orders").select(k.alias("id"), temporal.version_of_file(name).cast("string").alias("valid_from"))


_SPACE = r"trim(regexp_replace({}, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_SPACE.format('text')}) AS norm_md5, length({_SPACE.format('text')})::BIGINT AS norm_length FROM documents")
def norm_space(spark, d):
    n = T.normalize_space(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(n.cast("binary")).alias("norm_md5"), F.length(n).cast("long").alias("norm_length"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')) AS slug_md5 FROM documents")
def slug(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.slug(F.col("text")).cast("binary")).alias("slug_md5"))


_K = "p_partkey % 8"
_LINE = f"""CASE {_K} WHEN 0 THEN '(' || p_size || ') ' || p_name WHEN 1 THEN '(c) ' || p_name WHEN 2 THEN p_size || '.1 (a) ' || p_name WHEN 3 THEN 'b. ' || p_name
WHEN 4 THEN p_size || '. ' || p_name WHEN 5 THEN 'iv)  ' || p_name WHEN 6 THEN '- ' || p_name ELSE p_name END"""


def _line():
    k, n, s = F.col("p_partkey") % 8, F.col("p_name"), F.col("p_size").cast("string")
    c = F.concat
    return F.when(k == 0, c(F.lit("("), s, F.lit(") "), n)).when(k == 1, c(F.lit("(c) "), n)).when(k == 2, c(s, F.lit(".1 (a) "), n)).when(k == 3, c(F.lit("b. "), n)).when(k == 4, c(s, F.lit(". "), n)).when(k == 5, c(F.lit("iv)  "), n)).when(k == 6, c(F.lit("- "), n)).otherwise(n)


_KINDS = f"CASE {_K} WHEN 0 THEN 'numeric' WHEN 1 THEN 'roman' WHEN 2 THEN 'dotted_numeric' WHEN 3 THEN 'alpha' WHEN 4 THEN 'numeric' WHEN 5 THEN 'roman' WHEN 6 THEN 'other' ELSE 'none' END"


@query(f"""SELECT p_partkey AS id, CASE {_K} WHEN 0 THEN '(' || p_size || ')' WHEN 1 THEN '(c)' WHEN 2 THEN p_size || '.1(a)' WHEN 3 THEN 'b.' WHEN 4 THEN p_size || '.' WHEN 5 THEN 'iv)' WHEN 6 THEN '-' END AS raw,
CASE {_K} WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'c' WHEN 2 THEN p_size || '_1_a' WHEN 3 THEN 'b' WHEN 4 THEN p_size::VARCHAR WHEN 5 THEN 'iv' END AS token, p_name AS text FROM part""")
def markers(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), C.marker(_line()).alias("m")).select("id", "m.*")


@query(f"SELECT p_partkey AS id, {_KINDS} AS kind FROM part")
def marker_kind(spark, d):
    return markers(spark, d).select("id", C.marker_kind(F.col("raw"), F.col("token")).alias("kind"))


@query("SELECT p_partkey AS id, p_size || 'bis' AS article, 'art_' || p_size || 'bis__para_' || (p_partkey % 9) AS eid, p_size % 2 = 0 AS roman, '/akn/un/act/' || 'treaty' || '/wipo/1971-01-01/' || lower(p_brand) AS iri, printf('%04d_%s_clean.xml', 1900 + p_size, p_brand) AS file FROM part")
def tokens(spark, d):
    n = F.concat(F.col("p_size").cast("string"), F.lit(" bis."))
    roman = T.is_roman(F.when(F.col("p_size") % 2 == 0, "XIV").otherwise("xyz"))
    iri = T.work_iri(F.lit("treaty"), F.lit("1971-01-01"), F.lower("p_brand"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.article_token(n).alias("article"), T.eid_of(n, F.concat(F.lit("("), (F.col("p_partkey") % 9).cast("string"), F.lit(")"))).alias("eid"), roman.alias("roman"), iri.alias("iri"), T.file_name(F.col("p_size") + 1900, F.col("p_brand")).alias("file"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01-01' WHEN 2 THEN '1883-01-01' ELSE '1999-01-01' END AS date FROM orders")
def date_from_text(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Adopted at Paris on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and amended"))).when(k == 1, F.concat(F.lit("of "), F.date_format("o_orderdate", "yyyy"), F.lit(", revised"))).when(k == 2, F.lit("February 30, 1883")).otherwise(F.lit("no date"))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.date_from_text(text, F.lit(1999)).alias("date"))


_REF = "CASE p_partkey % 4 WHEN 0 THEN '§ ' || p_size || '(' || (p_partkey % 9) || ')(a) UrhG' WHEN 1 THEN 'Art. ' || p_size || ' LDA' WHEN 2 THEN 'L' || p_size || '-' || (p_partkey % 9) || ' CPI' ELSE 's. ' || p_size || ' Copyright Act 1994' END"


def _ref():
    k, s, n = F.col("p_partkey") % 4, F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")
    c = F.concat
    return F.when(k == 0, c(F.lit("§ "), s, F.lit("("), n, F.lit(")(a) UrhG"))).when(k == 1, c(F.lit("Art. "), s, F.lit(" LDA"))).when(k == 2, c(F.lit("L"), s, F.lit("-"), n, F.lit(" CPI"))).otherwise(c(F.lit("s. "), s, F.lit(" Copyright Act 1994")))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '§ ' || p_size WHEN 1 THEN 'Art. ' || p_size WHEN 2 THEN 'L' || p_size || '-' || (p_partkey % 9) ELSE 's. ' || p_size END AS norm FROM part")
def norm_ref(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), C.norm_ref(_ref()).alias("norm"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 9) || ',a' ELSE '' END AS subs FROM part")
def sub_refs(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(C.sub_refs(_ref()), ",").alias("subs"))


_LABEL = r"(?i)^(?:articles?|artikel|art\.?|sections?|sec\.?|s\.|§)\s*"
_FITS = r"({a} = {b} OR (starts_with({b}, {a}) AND NOT regexp_matches(substr({b}, length({a}) + 1, 1), '^[\p{{L}}\p{{N}}]')))"


@query(rf"""WITH p AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 9 AS n, p_partkey % 8 AS k, CASE p_partkey % 4 WHEN 0 THEN '§ ' || p_size WHEN 1 THEN 'Art. ' || p_size WHEN 2 THEN 'L' || p_size || '-' || (p_partkey % 9) ELSE 's. ' || p_size END AS q0, p_name FROM part),
r AS (SELECT id, CASE WHEN k = 5 THEN 'L' || s || '-' || n ELSE q0 END AS q, CASE k WHEN 0 THEN q0 WHEN 1 THEN q0 || '0' WHEN 2 THEN 'Article ' || s WHEN 3 THEN q0 || ' ' || p_name WHEN 4 THEN 'Section ' || s || 'a' WHEN 5 THEN 'L. ' || s || '-' || n WHEN 6 THEN s || '-' || n ELSE '' END AS c FROM p),
x AS (SELECT *, regexp_replace(q, '[\s.]', '', 'g') AS q2, regexp_replace(c, '[\s.]', '', 'g') AS c2, regexp_replace(regexp_replace(trim(q), '{_LABEL}', ''), '[\s.]', '', 'g') AS q3, regexp_replace(regexp_replace(trim(c), '{_LABEL}', ''), '[\s.]', '', 'g') AS c3 FROM r)
SELECT id, q <> '' AND c <> '' AND ({_FITS.format(a='q', b='c')} OR {_FITS.format(a='q2', b='c2')} OR (q3 <> '' AND {_FITS.format(a='q3', b='c3')})) AS fits FROM x""")
def refs_match(spark, d):
    k, s, n = F.col("p_partkey") % 8, F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")
    q0, c = C.norm_ref(_ref()), F.concat
    q = F.when(k == 5, c(F.lit("L"), s, F.lit("-"), n)).otherwise(q0)
    other = F.when(k == 0, q0).when(k == 1, c(q0, F.lit("0"))).when(k == 2, c(F.lit("Article "), s)).when(k == 3, c(q0, F.lit(" "), F.col("p_name"))).when(k == 4, c(F.lit("Section "), s, F.lit("a"))).when(k == 5, c(F.lit("L. "), s, F.lit("-"), n)).when(k == 6, c(s, F.lit("-"), n)).otherwise("")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), C.refs_match(q, other).alias("fits"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN CASE WHEN p_partkey % 3 = 0 THEN p_size || 'bis' ELSE 'IV' END END AS display, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS heading, CASE WHEN p_partkey % 3 = 2 THEN 'chapter' END AS container FROM part")
def heading_parse(spark, d):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    line = F.when(k == 0, F.concat(F.lit("Article "), F.col("p_size").cast("string"), F.lit(" bis : "), n)).when(k == 1, F.concat(F.lit("ARTICLE IV - "), n)).otherwise(F.concat(F.lit("Chapter II: "), n))
    h, c = C.article_heading(line), C.container_heading(line)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), h["display"].alias("display"), h["heading"].alias("heading"), c["kind"].alias("container"))


def _sentence():
    s = F.col("p_size").cast("string")
    return F.concat(F.lit('"'), F.col("p_name"), F.lit('" means '), F.col("p_type"), F.lit(" under Article "), s, F.lit("(2) and Articles 7 bis of the Paris Convention."))


@query("SELECT p_partkey AS id, p_name AS term FROM part")
def def_extract(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(C.definitions(_sentence())).alias("term"))


@query("SELECT p_partkey AS id, p_size::VARCHAR AS article, '2' AS para FROM part UNION ALL SELECT p_partkey, '7 bis', '' FROM part")
def ref_extract(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(C.references(_sentence())).alias("r")).select("id", "r.*")


@query("SELECT p_partkey AS id, 'paris' AS treaty FROM part UNION ALL SELECT p_partkey, 'rome' FROM part WHERE p_partkey % 3 = 0")
def alias_refs(spark, d):

    text = F.concat(_sentence(), F.when(F.col("p_partkey") % 3 == 0, " See the Rome Convention.").otherwise(" See Romeo."))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    return enrich.alias_matches(rows, {"Paris Convention": "paris", "Rome Convention": "rome", "Rome": "rome"}).select("id", "treaty")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS id, l_linenumber * 20 AS a, l_linenumber * 20 + l_quantity::BIGINT AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, -l_quantity, l_partkey, l_suppkey) AS n, l_linenumber AS line FROM lineitem),
r AS (SELECT id, n, CASE WHEN true THEN b END AS cur, true AS kept, a FROM s WHERE n = 1
UNION ALL SELECT s.id, s.n, CASE WHEN s.a < r.cur THEN r.cur ELSE s.b END, s.a >= r.cur, s.a FROM s JOIN r ON s.id = r.id AND s.n = r.n + 1)
SELECT id, count(*)::BIGINT AS n_kept, sum(a)::BIGINT AS starts FROM r WHERE kept GROUP BY id""")
def span_pick(spark, d):
    start = (F.col("l_linenumber") * 20).cast("long")
    span = F.struct(start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.lit("def").alias("kind"))
    spans = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(span).alias("spans"))
    kept = spans.withColumn("kept", ordered.pick_spans(F.col("spans")))
    return kept.select("id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, s: a + s["start"]).alias("starts"))


@query("SELECT event_id, 'def_term_' || event_type || '_' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS eid FROM events")
def def_ordinal(spark, d):
    out = ordered.numbered(_t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("event_id", F.concat(F.lit("def_term_"), "event_type", F.lit("_"), F.col("n").cast("string")).alias("eid"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, 'art_' || l_orderkey || '__para_' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS eid FROM lineitem")
def para_numbering(spark, d):
    out = ordered.numbered(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    eid = F.concat(F.lit("art_"), F.col("l_orderkey").cast("string"), F.lit("__para_"), F.col("n").cast("string"))
    return out.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), eid.alias("eid"))


@query("WITH x AS (SELECT event_id, user_id || '_' || event_type AS b, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT event_id, b || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS id FROM x")
def unique_suffix(spark, d):
    e = _t(spark, d, "events").withColumn("base", F.concat_ws("_", F.col("user_id").cast("string"), "event_type"))
    return ordered.unique_ids(e, ["user_id"], ["ts", "event_id"], "base").select("event_id", "id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS container FROM events")
def carry_forward(spark, d):
    out = ordered.carry_forward(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "container")
    return out.select("event_id", "container")


@query("""WITH x AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM x) SELECT user_id, run, any_value(event_type) AS event_type, count(*)::BIGINT AS length FROM y GROUP BY user_id, run""")
def islands_runs(spark, d):
    return ordered.runs(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT event_id, coalesce(lead(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) > length(event_type) AS has_nested FROM events")
def lookahead(spark, d):
    e = _t(spark, d, "events").withColumn("depth", F.length("event_type"))
    return ordered.lookahead(e, ["user_id"], ["ts", "event_id"], "depth").select("event_id", "has_nested")


_IDS = "SELECT 'doc_' || (event_id % 50) AS doc, user_id || '_' || event_type AS eid FROM events"
_REFS = "SELECT 'doc_' || (event_id % 50) AS doc, '#' || (user_id + 1) || '_' || event_type AS href FROM events"


def _ids_refs(spark, d):
    e = _t(spark, d, "events")
    doc = F.concat(F.lit("doc_"), (F.col("event_id") % 50).cast("string")).alias("doc")
    ids = e.select(doc, F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("eid"))
    return ids, e.select(doc, F.concat(F.lit("#"), (F.col("user_id") + 1).cast("string"), F.lit("_"), "event_type").alias("href"))


@query(f"SELECT doc, eid, count(*)::BIGINT AS n FROM ({_IDS}) GROUP BY doc, eid HAVING count(*) > 1")
def dup_ids(spark, d):
    return validate.duplicate_ids(_ids_refs(spark, d)[0])


@query(f"SELECT DISTINCT r.doc, r.href FROM ({_REFS}) r WHERE NOT EXISTS (SELECT 1 FROM ({_IDS}) i WHERE i.doc = r.doc AND '#' || i.eid = r.href)")
def missing_refs(spark, d):
    ids, refs = _ids_refs(spark, d)
    return validate.missing_refs(refs, ids)


def _letter(n):
    return F.chr(n + 97)


def _akn(spark, d, *columns):
    """An act for each part: two articles with paragraphs, a list of one to four points, a note, a definition and references, some of them broken."""
    k, n, s = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    c = F.concat
    dup = F.when(k % 5 == 0, "art_1__para_1").otherwise("art_1__para_2")
    target = F.when(k % 7 == 0, "art_9").otherwise("art_2")
    term = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit('<TLCTerm eId="term_x" href="/t" showAs="x"/>'))
    point = lambda i: c(F.lit('<point eId="art_1__para_2__point_'), _letter(i), F.lit('"><num>('), _letter(i), F.lit(")</num><content><p>further</p></content></point>"))
    more = F.when(F.col("p_size") % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 4), point), "")).otherwise("")
    xml = c(
        F.lit('<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act name="a"><meta><identification source="#s"><FRBRWork><FRBRthis value="/akn/un/act/treaty/wipo/1971-01-01/x/!main"/><FRBRuri value="/akn/un/act/treaty/wipo/1971-01-01/'), s,
        F.lit('"/><FRBRdate date="1971-10-29" name="jolux:dateEntryInForce"/><FRBRalias name="eli" value="eli/'), s, F.lit('"/></FRBRWork></identification><references source="#s">'), term,
        F.lit('</references></meta><body><article eId="art_1"><num>Article 1</num><paragraph eId="art_1__para_1"><num>(1)</num><content><p><def eId="def_1" refersTo="#term_x">'), n,
        F.lit('</def> of <ref href="#'), target, F.lit('">Article 2</ref><authorialNote><p>note</p></authorialNote>.</p></content></paragraph><paragraph eId="'), dup, F.lit('"><num>(2)</num><list eId="l"><point eId="art_1__para_2__point_a"><num>(a)</num><content><p>first '), s,
        F.lit("</p></content></point>"), more, F.lit('</list></paragraph></article><article eId="art_2"><num>Article '), s, F.lit(" bis"), F.lit('</num><content><p>'), s, F.lit(" years after death.</p></content></article></body></act></akomaNtoso>"),
    )
    return akn.nodes(_spread(spark, d, "part").select(c(F.lit("part_"), k.cast("string")).alias("doc"), xml.alias("xml")), columns or None)


@query("""SELECT 'part_' || p_partkey AS doc, ((CASE WHEN p_partkey % 3 = 0 THEN 32 ELSE 33 END) + 4 * (p_size % 4))::BIGINT AS n_nodes, 2::BIGINT AS n_articles, 2::BIGINT AS n_paragraphs, (1 + p_size % 4)::BIGINT AS n_points, 1::BIGINT AS n_refs, 1::BIGINT AS n_defs FROM part""")
def akn_counts(spark, d):
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return _akn(spark, d, "doc", "tag").groupBy("doc").agg(F.count("*").alias("n_nodes"), count("article").alias("n_articles"), count("paragraph").alias("n_paragraphs"), count("point").alias("n_points"), count("ref").alias("n_refs"), count("def").alias("n_defs"))


@query("SELECT 'part_' || p_partkey AS doc, '(1)' || p_name || ' of Article 2.' AS passage FROM part")
def passage_text(spark, d):
    found = _akn(spark, d, "doc", "pre", "eid", "content")
    wanted = _t(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), F.lit("art_1__para_1").alias("eid"))
    return locate.passages(wanted, found).select("doc", "passage")


@query("SELECT 'part_' || p_partkey AS doc, 'Art. 1(2)(' || chr((97 + p_size % 4)::INT) || ') InfoSoc' AS ref, 'art_1__para_2__point_' || chr((97 + p_size % 4)::INT) AS eid FROM part UNION ALL SELECT 'part_' || p_partkey, p_size || 'bis LDA', 'art_2' FROM part UNION ALL SELECT 'part_' || p_partkey, 'Art. 99', '' FROM part")
def locate_citation(spark, d):
    found = locate.needed(_akn(spark, d)).persist()  # read several times below
    part = _t(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), F.explode(F.array(F.concat(F.lit("Art. 1(2)("), _letter(F.col("p_size") % 4), F.lit(") InfoSoc")), F.concat(F.col("p_size").cast("string"), F.lit("bis LDA")), F.lit("Art. 99"))).alias("ref"))
    return locate.find(part, found)


@query("SELECT 'part_' || p_partkey AS doc, '/akn/un/act/treaty/wipo/1971-01-01/' || p_size AS work_uri, '/akn/un/act/treaty/wipo/1971-01-01/x/!main' AS this, 'eli/' || p_size AS eli, '1971-10-29' AS in_force, '1971-10-29' AS point_in_time, false AS authoritative FROM part")
def frbr_fields(spark, d):
    return akn.frbr(_akn(spark, d)).select("doc", "work_uri", "this", "eli", "in_force", "point_in_time", "authoritative")


def _filed(spark, d, *columns):
    """A treaty for each part, with all its metadata; every seventh or so has one of six faults."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    c, fault = F.concat, lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    work, date = c(F.lit("/akn/un/act/treaty/wipo/1971-01-01/t"), s), F.lit("1971-01-01")
    expr = c(work, F.lit("/eng@"), date)
    mani = c(expr, F.lit(".xml"))
    level = lambda tag, uri, this, author, more="": c(F.lit(f'<{tag}><FRBRthis value="'), this, F.lit('"/><FRBRuri value="'), uri, F.lit('"/>'), author, F.lit(f"{more}</{tag}>"))
    by = lambda href, role: F.lit(f'<FRBRauthor href="{href}" as="{role}"/>')
    main = F.lit("/!main")
    xml = c(
        F.lit('<akomaNtoso><act name="a"><meta><identification source="'), fault(19, "#else", "#wipo"), F.lit('">'),
        level("FRBRWork", work, c(work, fault(13, "/main", "/!main")), by("#wipo", "#author"), '<FRBRcountry value="un"/>'),
        level("FRBRExpression", expr, c(expr, main), fault(11, "", '<FRBRauthor href="#wipo" as="#author"/>')), level("FRBRManifestation", mani, c(mani, main), by("#editor", "#editor")),
        F.lit('</identification><publication/><references source="#wipo">'), fault(3, "", '<TLCTerm eId="term_x" href="/t" showAs="x"/>'), F.lit('</references></meta><body><article eId="art_1"><num>Article 1</num><paragraph eId="art_1__para_1"><content><p><def eId="def_1" refersTo="#term_x">x</def> of <ref href="#'),
        fault(7, "art_9", "art_2"), F.lit('">Article 2</ref> and <ref href="http://else">else</ref></p></content></paragraph><paragraph eId="'), fault(5, "art_1__para_1", "art_1__para_2"), F.lit('"/></article><article eId="art_2"><paragraph eId="'), fault(17, "art_2__para_unmarked_1", "art_2__para_1"), F.lit('"/></article></body></act></akomaNtoso>'),
    )
    return akn.nodes(_spread(spark, d, "part").select(c(F.lit("part_"), k.cast("string")).alias("doc"), xml.alias("xml")), columns or None)


_VALID = "p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0"
_REPORT = f"""SELECT 'part_' || p_partkey AS doc, CASE WHEN p_partkey % 5 = 0 THEN 'art_1__para_1' ELSE '' END AS duplicate_eids, CASE WHEN p_partkey % 7 = 0 THEN '#art_9' ELSE '' END AS missing_refs, CASE WHEN p_partkey % 3 = 0 THEN 'def_1' ELSE '' END AS bad_defs,
concat_ws(',', CASE WHEN p_partkey % 13 = 0 THEN 'FRBRWork/FRBRthis has a wrong form,FRBRWork/FRBRthis is not FRBRuri and /!main' END, CASE WHEN p_partkey % 11 = 0 THEN 'FRBRExpression/FRBRauthor is missing' END, CASE WHEN p_partkey % 19 = 0 THEN 'identification@source is not #wipo' END) AS frbr_issues,
CASE WHEN p_partkey % 17 = 0 THEN 'art_2__para_unmarked_1' ELSE '' END AS unmarked, {_VALID} AS valid FROM part"""


@query(_REPORT)
def valid_report(spark, d):
    out = validate.report(_filed(spark, d, *validate.READ))
    return out.select("doc", *[F.array_join(c, ",").alias(c) for c in ("duplicate_eids", "missing_refs", "bad_defs", "frbr_issues", "unmarked")], "valid")


@query(f"""WITH s AS (SELECT count(*)::BIGINT AS total_files, count(*) FILTER (WHERE {_VALID})::BIGINT AS valid_files, count(*) FILTER (WHERE NOT ({_VALID}))::BIGINT AS invalid_files FROM part)
SELECT *, total_files || ' files: ' || valid_files || ' valid, ' || invalid_files || ' invalid' AS line, CASE WHEN invalid_files = 0 THEN 0 ELSE 1 END AS exit_code FROM s""")
def valid_summary(spark, d):
    return validate.console(validate.summary(validate.report(_filed(spark, d, *validate.READ))))


@query(f"SELECT page_id, {_SPACE.format(chr(39).join(['regexp_replace(regexp_extract(html, ', '(?s)<h1[^>]*>(.*?)</h1>', ', 1), ', '<[^>]*>', ', ', ' ', ', ', 'g', ')']))} AS title FROM pages")
def html_title(spark, d):
    return _t(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query()
def html_paragraphs(spark, d):
    pages = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc"), "html")
    return html.entries(pages)


_BOLD = "CASE WHEN p_partkey % 4 = 3 THEN 'abc' ELSE p_brand END"
_REST = "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE 'abc' END"


@query(f"SELECT p_partkey AS id, trim({_BOLD} || ' ' || {_REST}) AS text, length({_BOLD}) >= greatest(6, 0.6 * length(trim({_BOLD} || ' ' || {_REST}))) AS is_bold FROM part")
def bold_like(spark, d):
    """Paragraphs that begin in bold: short or long bold texts, followed by nothing, a few or many letters."""
    k = F.col("p_partkey")
    bold, rest = F.when(k % 4 == 3, "abc").otherwise(F.col("p_brand")), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_name")).otherwise("abc")
    text = F.concat(F.lit("<body><p><b>"), bold, F.lit("</b> "), rest, F.lit("</p></body>"))
    return html.entries(_spread(spark, d, "part").select(k.cast("string").alias("doc"), text.alias("html"))).select(F.col("doc").cast("long").alias("id"), "text", "is_bold")


_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT doc_id, md5({_ESC.format('text')}) AS escaped_md5 FROM documents")
def html_escape(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.html_escape(F.col("text")).cast("binary")).alias("escaped_md5"))


@query(f"WITH x AS (SELECT doc_id, {_ESC.format('text')} AS h, strpos({_ESC.format('text')}, 'the') AS i FROM documents) SELECT doc_id, md5(CASE WHEN i > 0 THEN substr(h, 1, i - 1) || '<mark class=\"highlight\">the</mark>' || substr(h, i + 3) ELSE h END) AS marked_md5 FROM x")
def highlight_first(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.highlight(T.html_escape(F.col("text")), F.lit("the")).cast("binary")).alias("marked_md5"))


@query("SELECT doc_id, substr(trim(text, ' '), 1, 800) AS passage FROM documents")
def passage_cut(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.cut_passage(F.col("text")).alias("passage"))


@query("SELECT o_orderkey AS doc, count(*)::BIGINT AS n_inside, sum(l_linenumber)::BIGINT AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 1 AND l_linenumber <= 4 GROUP BY o_orderkey")
def interval_descendants(spark, d):
    outer = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("pre"), F.lit(4).alias("post"))
    inner = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pre_in"))
    return locate.descendants(outer, inner).groupBy("doc").agg(F.count("*").alias("n_inside"), F.sum("pre_in").alias("lines"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 <> 1 AS work_uri, o_orderkey % 3 <> 1 AS work_this, o_orderkey % 3 = 0 AS expr_uri FROM orders")
def uri_format_check(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(k % 3 == 1, "Bad_Name").otherwise("good-name")
    uri = T.work_iri(F.lit("treaty"), day, name)
    expression = F.concat(uri, F.when(k % 3 == 0, "/eng@").otherwise("/fra@"), day)
    return _t(spark, d, "orders").select(k.alias("id"), validate.has_form(uri, "work_uri").alias("work_uri"), validate.has_form(F.concat(uri, F.lit("/!main")), "work_this").alias("work_this"), validate.has_form(expression, "expr_uri").alias("expr_uri"))


@query("SELECT p_partkey AS id, levenshtein(lower(p_name), lower(p_type))::BIGINT AS distance FROM part")
def text_distance(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.levenshtein(T.for_compare(F.col("p_name")), T.for_compare(F.col("p_type"))).cast("long").alias("distance"))


@query("""WITH x AS (SELECT p_partkey AS id, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN p_name || ' and more' WHEN 1 THEN upper(p_name) || '  ' WHEN 2 THEN '' ELSE p_name END AS b FROM part),
y AS (SELECT *, CASE WHEN b = '' THEN 0.0 ELSE 2.0 * length(a) / (length(a) + length(trim(b))) END::DOUBLE AS r FROM x)
SELECT id, round(r, 6) AS similarity, (1 - r) * 100 > 1 AS reverted, CASE WHEN (1 - r) * 100 > 1 THEN a ELSE b END AS kept FROM y""")
def similarity_check(spark, d):
    k, a = F.col("p_partkey") % 4, F.col("p_name")
    b = F.when(k == 0, F.concat(a, F.lit(" and more"))).when(k == 1, F.concat(F.upper(a), F.lit("  "))).when(k == 2, "").otherwise(a)
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))
    rows = rows.withColumn("similarity", enrich.similarity(F.col("b"), F.col("a")))
    return rows.select("id", F.round("similarity", 6).alias("similarity"), ((1 - F.col("similarity")) * 100 > 1).alias("reverted"), enrich.guarded(F.col("b"), F.col("a"), F.col("similarity")).alias("kept"))


@query("SELECT 'part_' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'rule_card' WHEN 1 THEN 'rights_list' ELSE 'yes_no_exception' END AS type, CASE WHEN p_size = 50 THEN 'Life of author + 50 years' ELSE p_size || ' years pma' END AS shown FROM part")
def viz_spec(spark, d):
    p = _t(spark, d, "part")
    rule = F.element_at(F.array(*map(F.lit, rules.CARDS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), F.lit(" years pma"))
    return p.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), rules.card(rule).alias("type"), rules.display_value(T.duration_kind(text)).alias("shown"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Copyright protection in ' || p_brand || ' lasts ' || p_size || ' years pma.' WHEN 1 THEN p_brand || ' grants: a, b.'
ELSE CASE WHEN p_size > 25 THEN 'Yes, ' || p_brand || ' has' ELSE 'No, ' || p_brand || ' does not have' END || ' a private-copy exception. ' || p_name END AS answer FROM part""")
def answer_text(spark, d):
    rule = F.element_at(F.array(*map(F.lit, rules.CARDS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    out = rules.answer(F.col("p_brand"), rule, F.concat(F.col("p_size").cast("string"), F.lit(" years pma")), F.lit("a, b"), F.col("p_size") > 25, F.col("p_name"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), out.alias("answer"))


def _rule_nodes(spark, d):
    found = G.star(_part_rules(spark, d), {"code": "jurisdiction", "rule": "ruleType"}, {"title": "docTitle"})
    return found.select("s", "code", F.col("code").alias("name"), "rule", F.coalesce("title", F.lit("")).alias("title"))


@query("""SELECT DISTINCT 'country_' || p_brand AS id, p_brand AS label, 'country' AS type FROM part UNION ALL SELECT 'part_' || p_partkey, 'copyright duration', 'rule' FROM part
UNION ALL SELECT DISTINCT 'law_' || p_name, p_name, 'law' FROM part WHERE p_partkey % 7 <> 0""")
def graph_nodes(spark, d):
    return rules.vertices(_rule_nodes(spark, d))


@query("SELECT 'country_' || p_brand AS source, 'part_' || p_partkey AS target, 'has rule' AS label FROM part UNION ALL SELECT 'part_' || p_partkey, 'law_' || p_name, 'stated in' FROM part WHERE p_partkey % 7 <> 0")
def graph_edges(spark, d):
    return rules.edges(_rule_nodes(spark, d))


def _treaty(spark, d):
    """HTML of a treaty for each part: two articles with paragraphs and a lettered list, then a second act that starts over."""
    n, s = F.col("p_name"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("<html><body><h1>Treaty "), n, F.lit("</h1><table><p>Contents</p></table><p>of January 1, 1971</p><p>The States, "), n, F.lit(",</p><p><b>Article 1 : Scope</b></p><p>(1) First "), s, F.lit(":</p><p>(a) one</p><p>(b) two</p><p>(2) Second</p>"),
        F.lit("<p><strong>Article 2<br>Terms</strong></p><p>Plain text.</p><ul><li><p>- bullet</p></li></ul><p>II Additional Act</p><p>Preamble.</p><p><b>Article 1 : Again</b></p><p>(1) More</p></body></html>"),
    )
    docs = _spread(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), text.alias("html"))
    return convert.blocks(html.entries(docs), docs.select("doc", html.title(F.col("html")).alias("title")))


@query("""SELECT 'part_' || p_partkey AS doc, s.seg, CASE s.seg WHEN 0 THEN 'Treaty ' || p_name ELSE 'Additional Act' END AS title, s.articles, s.paragraphs, s.preamble FROM part, (VALUES (0, 2::BIGINT, 3::BIGINT, 2::BIGINT), (1, 1, 1, 0)) s(seg, articles, paragraphs, preamble)""")
def convert_counters(spark, d):
    found = _treaty(spark, d)
    titles = found.groupBy("doc", "seg").agg(F.first("seg_title").alias("title"))
    return convert.counters(convert.article_nodes(found), found).join(titles.hint("merge"), ["doc", "seg"]).select("doc", "seg", "title", "articles", "paragraphs", "preamble")


@query("""SELECT 'part_' || p_partkey AS doc, e.seg, e.eid, e.tag FROM part, (VALUES (0, 'art_1', 'article'), (0, 'art_1__para_1', 'paragraph'), (0, 'art_1__para_1__list_1', 'list'), (0, 'art_1__para_1__list_1__point_a', 'point'), (0, 'art_1__para_1__list_1__point_b', 'point'), (0, 'art_1__para_2', 'paragraph'),
(0, 'art_2', 'article'), (0, 'art_2__para_1', 'paragraph'), (0, 'art_2__para_1__list_1', 'list'), (0, 'art_2__para_1__list_1__point_1', 'point'), (1, 'art_1', 'article'), (1, 'art_1__para_1', 'paragraph')) e(seg, eid, tag)""")
def convert_nodes(spark, d):
    return convert.article_nodes(_treaty(spark, d)).where("eid is not null").select("doc", "seg", "eid", "tag")


@query("""SELECT p_partkey AS id, s.n, s.kind, s.target FROM part, (VALUES (1, 'def', NULL), (2, 'ref_internal', '#art_7bis'), (3, 'ref_external', '/akn/paris')) s(n, kind, target) WHERE s.n > 1
UNION ALL SELECT p_partkey, 1, 'def', p_name FROM part UNION ALL SELECT p_partkey, 0, 'ref_internal', '#art_' || p_size FROM part WHERE p_partkey % 2 = 0""")
def annotate_spans(spark, d):
    p = _t(spark, d, "part")
    paragraphs = p.select(F.col("p_partkey").alias("doc"), F.lit(0).alias("pos"), _sentence().alias("text"))
    ids = p.select(F.col("p_partkey").alias("doc"), F.explode(F.array(F.lit("art_7bis"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("art_"), F.col("p_size").cast("string"))))).alias("eid"))
    marked = enrich.annotate(paragraphs, ids, {"Paris Convention": "paris", "Rome Convention": "rome"}, {"paris": "/akn/paris"})
    n = F.when(F.col("kind") == "def", 1).when(F.col("kind") == "ref_external", 3).when(F.col("target") == "#art_7bis", 2).otherwise(0)
    return marked.select(F.col("doc").alias("id"), n.alias("n"), "kind", "target")


_ACT = """<Statute pit-date="2020-01-01"><Identification><ShortTitle>{n}</ShortTitle><ConsolidatedNumber>C-42</ConsolidatedNumber></Identification><Body><Heading level="1"><Label>PART I</Label><TitleText>General</TitleText></Heading><Section><Label>{s}.1</Label><MarginalNote>Term</MarginalNote><Text>Lead</Text><Paragraph><Label>(a)</Label><Text>one</Text><Subparagraph><Label>(i)</Label><Text>deep</Text></Subparagraph></Paragraph></Section><Section><Text>no label</Text></Section></Body></Statute>"""
_NZ = """<act act.no="143" year="1994" date.as.at="2021-05-01"><cover><title>{n}</title></cover><body><part><label>1</label><heading>Rights</heading><prov><label>{s}</label><heading>Term</heading><prov.body><subprov><label>1</label><para><text>Lead:</text><label-para><label>a</label><para><text>one</text></para></label-para></para></subprov><subprov><label denominator="no">2</label><para><text>two</text></para></subprov></prov.body></prov></part></body></act>"""


@query("""SELECT 'part_' || p_partkey AS doc, CASE WHEN p_partkey % 3 = 0 THEN 'sec_' || p_size || '_1' WHEN p_partkey % 3 = 1 THEN 'sec_' || p_size END AS eid, CASE WHEN p_partkey % 3 = 0 THEN p_size || '.1TermLead(a)one(a)(i)deep' WHEN p_partkey % 3 = 1 THEN p_size || 'Term(1)Lead:(a)onetwo' END AS content FROM part WHERE p_partkey % 3 < 2""")
def national_sections(spark, d):
    k = F.col("p_partkey") % 3
    of = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("p_name")), F.lit("{s}"), F.col("p_size").cast("string"))
    xml = F.when(k == 0, of(_ACT)).when(k == 1, of(_NZ)).otherwise("<broken")
    docs = _spread(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("doc"), national.to_akn(xml, F.when(k == 1, "NZ").otherwise("CA")).alias("xml"))
    return akn.nodes(docs).where("tag = 'section'").select("doc", "eid", "content")


@query("""SELECT p_partkey AS id, '<section class="article target" id="target"><h4>Article ' || p_size || '</h4><div class="content"><p>lasts <mark class="highlight">' || p_size || ' years</mark> &amp; more</p></div></section>' AS html FROM part""")
def render_article(spark, d):
    s = F.col("p_size").cast("string")
    xml = F.concat(F.lit('<act><body><article eId="art_1"><num>Article '), s, F.lit("</num><content><p>lasts "), s, F.lit(" years &amp; more</p></content></article></body></act>"))
    return _spread(spark, d, "part").select(F.col("p_partkey").alias("id"), render.html(xml, F.lit("art_1"), F.concat(s, F.lit(" years"))).alias("html"))
