"""The legal operators on small fixtures of our own wording."""

import datetime as dt

from pyspark.sql import functions as F

from lexplane.functions import citations as C
from lexplane.functions import text as T
from lexplane.operators import enrich, locate, ordered, temporal
from lexplane.operators import triples as G
from lexplane.plans import rules
from lexplane.sources import akn, facts

CODES = {"DE": "Germany", "FR": "France", "IT": "Italy", "CH": "Switzerland", "UK": "United Kingdom", "US": "United States", "CA": "Canada", "NZ": "New Zealand", "EU": "European Union"}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def graph(spark, tmp_path):
    rows = [",".join(facts.COLUMNS)]
    for code, name in CODES.items():
        rental = "false" if code == "US" else "true"
        exc = {"UK": '"No; struck down (s. 28B CDPA)"', "US": "Fair use (§ 107)"}.get(code, "Yes (Art. 5(2)(b) Law)")
        rows.append(f'{code},{name},Law,http://x/{code},{50 if code == "NZ" else 70} years pma,none,{50 if code == "CH" else 70} years pma,none,true,true,true,{rental},true,"notes, with comma",A1,A2,A3,{"-" if rental == "false" else "A4"},A5,1990,2020,{exc}')
    (tmp_path / "facts.csv").write_text("\n".join(rows), encoding="utf-8")
    docs = spark.createDataFrame([("DE", None, "de.xml", "UrhG"), ("EU", "economic rights", "infosoc.xml", "InfoSoc"), ("EU", None, "term.xml", "Term")], "code string, rule string, path string, title string")
    return facts.triples(facts.read(spark, str(tmp_path / "facts.csv")), docs).cache()


def test_graph_and_compliance(spark, tmp_path):
    g = graph(spark, tmp_path)
    assert g.count() == 500
    by = {r.p: r["count"] for r in g.groupBy("p").count().collect()}
    assert by["legal:articleRef"] == 72 and by["legal:hasRight"] == by["legal:hasRightDetail"] == 44 and by["legal:compliesWith"] == 9
    assert by["legal:durationYears"] == by["legal:durationLiterary"] == by["ipronto:triggeredBy"] == 10
    yes = {r.s for r in g.where("p = 'legal:hasException' and o = 'true'").collect()}
    assert len(yes) == 7 and not yes & {"ex:UK_exception", "ex:US_exception"}
    found = {r.code: r for r in rules.compliance(g).collect()}
    assert len(found) == 9 and all(r.compliant and r.years >= 50 for r in found.values())
    assert found["NZ"].years == 50 and found["NZ"].margin == 0 and found["DE"].margin == 20
    assert found["DE"].path == "de.xml" and found["DE"].treaty_article == "Art. 7 Berne Convention"


def test_questions(spark, tmp_path):
    g = graph(spark, tmp_path)
    asked = spark.createDataFrame([("How long does copyright last in Switzerland?",), ("Which rights exist in Germany?",), ("Is there a private copy exception in Italy?",), ("Tell me about it",)], "question string")
    got = {r.question[:5]: r for r in rules.evidence(rules.route(rules.enrich(asked)), g).collect()}
    assert got["How l"].article == "Art. 29 URG" and got["How l"].value == "life_plus_70" and got["How l"].answer.endswith("lasts 70 years pma.")
    assert got["Which"].answer == "Germany grants: communication, distribution, rental, reproduction, translation."
    assert got["Is th"].value == "yes" and got["Is th"].article == "Art. 5(2)(b) Law"
    assert got["Tell "].code == "WIPO" and got["Tell "].answer == ""
    eu = rules.evidence(spark.createDataFrame([("EU", "economic rights"), ("EU", "copyright duration")], "code string, rule string"), g).select("path").distinct()
    assert eu.count() == 2
    cards = [one(spark, rules.card(F.lit(r))) for r in ("copyright duration", "economic rights", "personal-use exception")]
    assert cards == ["rule_card", "rights_list", "yes_no_exception"]
    text = one(spark, rules.full_answer(F.lit("A."), F.lit(" some \n passage "), F.lit("Art. 1"), F.lit("T"), F.lit("t.xml"), F.lit("")))
    assert all(x in text for x in ("Answer: A.", 'Evidence: "some passage"', "Reference: Art. 1", "Document: [T](t.xml)", "Note:"))


def test_text_functions(spark):
    s = lambda f, x: one(spark, f(F.lit(x)))
    assert s(T.normalize_space, " a   b​c\n") == "a bc"
    assert s(T.slug, "Œuvre Éléments — n° 3½!") == "uvre-elements-n-312"
    assert s(T.article_token, "3 Bis.") == "3bis" and s(T.marker_token, "1.1 (a)") == "1_1_a" and s(T.marker_token, "(b)") == "b"
    assert one(spark, T.date_from_text(F.lit("done on March 5,1999"), F.lit(1900))) == "1999-03-05"
    assert one(spark, T.date_from_text(F.lit("February 30, 1883"), F.lit(1900))) == "1883-01-01"
    assert one(spark, T.date_from_text(F.lit("nothing"), F.lit(1900))) == "1900-01-01"
    assert s(T.exception_article, "Yes (Art. 5(2)(b) InfoSoc)") == "Art. 5(2)(b) InfoSoc"
    assert one(spark, T.duration_span(F.lit("for 70 years after the death, and"), F.lit("70 years pma"))) == "70 years after the death"
    assert s(T.exclusive_span, "has the Exclusive Right to copy. Other") == "Exclusive Right to copy"
    assert one(spark, T.highlight(F.lit("a &lt; b &lt; c"), F.lit("<"))) == 'a <mark class="highlight">&lt;</mark> b &lt; c'
    assert s(T.looks_like_date, "(as amended on July 1, 1999)") and not s(T.looks_like_date, "Office")
    assert s(T.looks_editorial, "Editor’s note: x") and s(T.looks_like_contents, "Contents")
    assert s(T.strip_code_fence, "```json\n{}\n```") == "{}" and s(T.pdf_name, "data/wipo/1981_nairobi_clean.xml") == "nairobi.pdf"


def test_citations(spark):
    norm = lambda x: one(spark, C.norm_ref(F.lit(x)))
    fits = lambda q, c: one(spark, C.refs_match(F.lit(q), F.lit(c)))
    assert norm("§ 64 UrhG") == "§ 64" and norm("Art. 5(2)(b) InfoSoc") == "Art. 5" and norm("L123-1 CPI") == "L123-1"
    assert fits("§ 64", "§ 64 Allgemeines") and not fits("§ 64", "§ 64a")
    assert fits("L123-1", "Article L123-1") and fits("L123-1", "L. 123-1") and not fits("L123-1", "L123-10") and fits("L122-2", "L122-2-2")
    assert fits("s. 12", "12") and not fits("", "12")
    h = one(spark, C.article_heading(F.lit("Article VI bis - Rights")))
    assert (h.token, h.display, h.heading) == ("vibis", "VIBIS", "Rights")
    c = one(spark, C.container_heading(F.lit("II Additional Act of Stockholm")))
    assert c.split and c.kind == "part" and one(spark, C.container_heading(F.lit("I am a sentence"))) is None
    assert one(spark, C.segment_name(F.lit("madrid"), F.lit("Additional Act"), F.lit(1))) == "madrid-additional-act"


ACT = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><body>
<article eId="art_l122_1"><num>L122-1</num><content><p>Exploitation.</p></content></article>
<article eId="art_l122_10"><num>L122-10</num><content><p>Ten.</p></content></article>
<section eId="sec_5"><num>Article 5</num><subsection eId="sec_5__2"><num>(2)</num><paragraph eId="sec_5__2__b"><num>(b)</num><content><p>Private <authorialNote><p>skip</p></authorialNote>use</p></content></paragraph></subsection></section>
</body></act></akomaNtoso>"""


def test_locate_and_passages(spark):
    nodes = akn.nodes(spark.createDataFrame([("d", ACT), ("broken", "<a>"), ("none", None)], "doc string, xml string")).cache()
    assert nodes.select("doc").distinct().count() == 1
    asked = spark.createDataFrame([("d", "L122-1 CPI"), ("d", "L122-10"), ("d", "Art. 5(2)(b) InfoSoc"), ("d", "Art. 5(9)"), ("d", "Art. 77"), ("broken", "1")], "doc string, ref string")
    got = {r.ref: r.eid for r in locate.find(asked, nodes).collect()}
    assert got == {"L122-1 CPI": "art_l122_1", "L122-10": "art_l122_10", "Art. 5(2)(b) InfoSoc": "sec_5__2__b", "Art. 5(9)": "sec_5", "Art. 77": "", "1": ""}
    text = locate.passages(spark.createDataFrame([("d", "sec_5__2__b"), ("d", "zz")], "doc string, eid string"), nodes)
    assert {r.eid: r.passage for r in text.collect()} == {"sec_5__2__b": "(b)Private use", "zz": ""}


def test_asof_boundaries(spark):
    v = spark.createDataFrame([("IT", dt.date(1941, 7, 16), "V0"), ("IT", dt.date(1973, 5, 31), "V6"), ("IT", dt.date(1970, 1, 1), "V5"), ("IT", dt.date(1970, 1, 1), "V4")], "code string, at date, file string")
    t = spark.createDataFrame([("IT", dt.date(*x)) for x in ((1973, 5, 30), (1973, 6, 1), (1900, 1, 1), (1941, 7, 16), (2030, 1, 1))] + [("XX", dt.date(2000, 1, 1))], "code string, at date")
    for bucket in (None, F.year("at"), F.floor(F.year("at") / 10)):
        got = {(r.code, str(r.at)): r.version for r in temporal.asof(t, v.withColumnsRenamed({"file": "version"}).withColumn("file", F.col("version")), "code", "at", "version", "file", bucket).collect()}
        assert got == {("IT", "1973-05-30"): "V5", ("IT", "1973-06-01"): "V6", ("IT", "1900-01-01"): None, ("IT", "1941-07-16"): "V0", ("IT", "2030-01-01"): "V6", ("XX", "2000-01-01"): None}


def test_spans_and_depths(spark):
    rows = spark.createDataFrame([(1, [(0, 5, "ref_external"), (0, 5, "def"), (3, 9, "def"), (5, 6, "ref_internal"), (6, 20, "def")])], "id int, s array<struct<start:long,end:long,kind:string>>")
    kept = rows.select(ordered.pick_spans(F.col("s")).alias("k")).first().k
    assert [(x.start, x.kind) for x in kept] == [(0, "def"), (5, "ref_internal"), (6, "def")]
    blocks = spark.createDataFrame([([(0, "numeric", "a"), (0, "alpha", "b"), (0, "roman", "c"), (0, "none", "ends:"), (0, "alpha", "d"), (2, "none", "e"), (0, "none", "f"), (0, "alpha", "g")],)], "b array<struct<depth:int,kind:string,text:string>>")
    assert blocks.select(ordered.list_depths(F.col("b")).alias("d")).first().d == [0, 1, 1, 0, 1, 2, 0, 0]


def test_definitions_get_ids(spark):
    p = spark.createDataFrame([("d", 0, '"Broadcast" means x; "broadcast" means y'), ("d", 1, "“Satellite” shall mean z")], "doc string, pos int, text string")
    ids = spark.createDataFrame([], "doc string, eid string")
    got = enrich.definition_ids(enrich.annotate(p, ids, {}, {})).orderBy("pos", "start").select("def_eid").collect()
    assert [r.def_eid for r in got] == ["def_term_broadcast_1", "def_term_broadcast_2", "def_term_satellite_1"]
    same, cut = (one(spark, enrich.similarity(F.lit("A  b"), F.lit(x))) for x in ("a b", ""))
    assert same == 1.0 and cut == 0.0


def test_ntriples(spark):
    df = spark.createDataFrame([("s", "p", 'a "b"\n\\', "literal", "string"), ("s", "p", "o", "uri", ""), ("s", "p", "5", "literal", "integer")], ", ".join(f"{c} string" for c in G.COLUMNS))
    assert {r.value for r in G.to_ntriples(df).collect()} == {'<urn:x:s> <urn:x:p> "a \\"b\\"\\n\\\\" .', "<urn:x:s> <urn:x:p> <urn:x:o> .", '<urn:x:s> <urn:x:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .'}


def test_engine(spark, tmp_path):
    from lexplane.api import Engine

    g = graph(spark, tmp_path)
    xml = '<act><body><article eId="a64"><num>§ 64</num><content><p>The right lasts 70 years after death.</p></content></article></body></act>'
    docs = spark.createDataFrame([("de.xml", xml), ("v1", xml), ("v2", "<act><body/></act>")], "doc string, xml string")
    versions = spark.createDataFrame([("DE", dt.date(1990, 1, 1), "v1"), ("DE", dt.date(2000, 1, 1), "v2")], "code string, at date, file string")
    e = Engine(g, docs, versions)
    a = e.ask(spark.createDataFrame([("How long is the duration in Germany?",)], "question string")).first()
    assert a.eid == "a64" and a.passage.endswith("70 years after death.") and a.card == "rule_card" and "§ 64 UrhG" in a.text
    assert e.compliance("DE").first().passage.startswith("§ 64") and e.compliance("XX").count() == 0 and e.compliance().count() == 9
    t = spark.createDataFrame([("DE", dt.date(*d), "a64", "") for d in ((1980, 1, 1), (1990, 1, 1), (2001, 1, 1))] + [("DE", None, "a64", "")], "code string, at date, eid string, span string")
    assert {str(r.at): r.status for r in e.document(t).collect()} == {"1980-01-01": "before_first", "1990-01-01": "resolved", "2001-01-01": "missing_provision", "None": "invalid_date"}
    v, ed, tr = e.graph("de")
    assert v.where("type = 'rule'").count() == 3 and ed.count() == 6 and tr.count() > 20 and e.graph("zz")[0].count() == 0
    assert [r.code for r in e.countries().collect()][:2] == ["DE", "FR"] and e.versions_of("DE").count() == 2


def test_treaties_and_terms(spark, tmp_path):
    from lexplane.sources import treaties

    assert treaties.registry(spark).count() == 28 and len(treaties.ALIASES) == 37
    found = treaties.known(spark.createDataFrame([("1981_Nairobi_clean.html",), ("x.html",)], "file string")).collect()
    assert [(r.short_name, r.year) for r in found] == [("nairobi", 1981)]
    frbr = spark.createDataFrame([("a", "/akn/un/act/treaty/wipo/1981-01-01/nairobi/"), ("b", None)], "doc string, work_uri string")
    assert [tuple(r) for r in treaties.work_uris(frbr).select("short_name").collect()] == [("nairobi",)]
    treaties.write_index(spark.createDataFrame([("x", "/x")], "short_name string, work_uri string"), str(tmp_path / "index"))
    assert treaties.work_uris(frbr, treaties.read_index(spark, str(tmp_path / "index"))).first().work_uri == "/x"
    marked = spark.createDataFrame([("d", 0, 0, "Broadcast", "term_broadcast"), ("d", 1, 0, "broadcast", "term_broadcast"), ("d", 2, 0, "Old", "term_old")], "doc string, pos int, start int, target string, term_eid string")
    terms = spark.createDataFrame([("d", "term_old", "Old")], "doc string, eid string, shown string")
    assert {(r.eid, r.shown) for r in enrich.upsert_terms(terms, marked).collect()} == {("term_old", "Old"), ("term_broadcast", "Broadcast")}


def test_national_outlines_nest_by_depth():
    """Provisions close deeper boxes only; boxes close those as deep; labels of items run on; odd tags are passed over."""
    import xml.etree.ElementTree as ET

    from lexplane.sources import national

    nz = """<act act.no="1" year="2000"><cover><title>T</title></cover><body><prov><label>1</label></prov><part><label>1</label><heading>P</heading><subpart><label>2</label><crosshead>Cross</crosshead>
<prov><label>2</label><prov.body><para><text>Lead</text><label-para><label>a</label><para><text>one</text><label-para><label>i</label><para><text>deep</text></para></label-para></para></label-para></para></prov.body></prov></subpart>
<prov><label>3</label><heading>H</heading></prov></part><prov><label>4</label></prov><crosshead><heading>Last</heading></crosshead><prov><label>5</label></prov><prov><heading>no label</heading></prov></body></act>"""
    local = lambda t: t.rsplit("}", 1)[-1]
    root = ET.fromstring(national.new_zealand(nz))
    up = {c: p for p in root.iter() for c in p}
    around = {el.get("eId"): up[el].get("eId") for el in root.iter() if el.get("eId")}
    assert around == {"sec_1": None, "part_1": None, "chapter_2": "part_1", "crossheading_1": "chapter_2", "sec_2": "crossheading_1", "sec_3": "chapter_2", "sec_4": "part_1", "crossheading_2": None, "sec_5": "crossheading_2"}
    assert [("".join(e.itertext())) for e in root.iter() if local(e.tag) == "item"] == ["(a)one", "(a)(i)deep"]
    ca = """<Statute pit-date="2020-01-01"><Identification/><Body><Heading level="1"><Label>PART I</Label></Heading><Heading level="2"><TitleText>Sub</TitleText></Heading><Section><Label>1</Label><Text>Lead</Text><Subsection><Label>(1)</Label><Text>own</Text><Paragraph><Label>(a)</Label><Text>x</Text></Paragraph></Subsection></Section>
<Heading level="1"><TitleText>Other</TitleText></Heading><Section><Label>2</Label></Section></Body></Statute>"""
    root = ET.fromstring(national.canada(ca))
    up = {c: p for p in root.iter() for c in p}
    around = {el.get("eId"): up[el].get("eId") for el in root.iter() if el.get("eId")}
    assert around == {"part_i": None, "crossheading_1": "part_i", "sec_1": "crossheading_1", "sec_1__intro": "sec_1", "sec_1__subsec_1": "sec_1", "crossheading_2": None, "sec_2": "crossheading_2"}


def test_reports(spark):
    """Schema findings count, reports are JSON lines, and a bare document has every issue of metadata."""
    import json

    from lexplane.operators import validate

    nodes = akn.nodes(spark.createDataFrame([("a", ACT), ("b", ACT)], "doc string, xml string"))
    schema = spark.createDataFrame([("b", ["line 1"])], "doc string, schema_errors array<string>")
    found = {r.doc: r for r in validate.report(nodes, schema).collect()}
    assert found["a"].schema_errors == [] and found["b"].schema_errors == ["line 1"] and not found["a"].valid
    assert len(found["a"].frbr_issues) == 13 and "publication is missing" in found["a"].frbr_issues
    line = json.loads(validate.as_json(validate.report(nodes)).first().value)
    assert line["doc"] in "ab" and line["valid"] is False
    assert validate.console(validate.summary(validate.report(nodes))).first().exit_code == 1


def test_triples_read_again(spark):
    rows = [("s", "p", 'a "b"\n\\n\\', "literal", "string"), ("s", "p", "o", "uri", ""), ("s", "p", "5", "literal", "integer"), ("s", "q", "", "literal", "string")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in G.COLUMNS))
    lines = G.to_ntriples(df).union(spark.createDataFrame([("# note",), ("",)], "value string"))
    assert sorted(tuple(r) for r in G.from_ntriples(lines).collect()) == sorted(rows)


def test_baseline_and_fallback(spark, tmp_path):
    g = graph(spark, tmp_path)
    without = rules.compliance(g.where("s <> 'ex:WIPO_berne_art7'")).collect()
    assert len(without) == 9 and all(r.compliant is None and r.baseline is None for r in without)
    records = spark.createDataFrame([(1, "A", "r", "first", "1"), (2, "B", "r", "own", "2")], "n int, code string, rule string, answer string, article string")
    asked = spark.createDataFrame([("B", "r"), ("C", "r"), ("A", "x")], "code string, rule string")
    assert {(r.code, r.rule): r.answer for r in rules.fallback(asked, records).collect()} == {("B", "r"): "own", ("C", "r"): "first", ("A", "x"): ""}


def test_documents_are_valid_and_read_again(spark, tmp_path):
    """Chapters open and close around their articles, markup is escaped, and an assembled document has no finding."""
    from lexplane.operators import assemble, convert, validate
    from lexplane.sources import html

    text = "<h1>A & B</h1><p>of May 2, 1980</p><p>Parties &lt;all&gt;</p><p>CHAPTER I : General</p><p><b>Article 1 : Scope</b></p><p>(1) a &amp; b</p><p><b>Article 2 : Terms</b></p><p>One</p><p>CHAPTER II</p><p><b>Article 3 : Last</b></p><p>(1) Lead</p><p>(a) x</p><p>(i) y</p><p>(2) End</p>"
    docs = spark.createDataFrame([("t", text), ("none", "<h1>None</h1><p>only a line</p>"), ("unknown", text)], "doc string, html string")
    found = convert.blocks(html.entries(docs), docs.select("doc", html.title(F.col("html")).alias("title"))).cache()
    known = spark.createDataFrame([("t", "ab", "treaty", 1900), ("none", "none", "treaty", 1901)], "doc string, short_name string, kind string, year int")
    out = assemble.documents(found, convert.article_nodes(found), known).cache()
    rows = {r.doc: r for r in out.collect()}
    assert set(rows) == {"t", "none"} and rows["t"].file == "1980_ab_clean.xml" and rows["none"].date == "1901-01-01"
    assert "<body></body>" in rows["none"].xml and "Parties &lt;all&gt;</p></preamble>" in rows["t"].xml
    tree = {r.eid: r for r in akn.nodes(out.select("doc", "xml")).where("doc = 't' and eid is not null").collect()}
    up = lambda a, b: tree[b].pre < tree[a].pre <= tree[b].post
    assert up("art_1", "chapter_i") and up("art_2", "chapter_i") and up("art_3", "chapter_ii") and not up("art_3", "chapter_i")
    assert tree["chapter_i"].num == "CHAPTER I" and tree["art_1__para_1"].content == "(1)a & b" and tree["art_3__para_2"].content == "(2)End"
    assert all(r.valid for r in validate.report(akn.nodes(out.select("doc", "xml"))).collect())
    assemble.write(out, str(tmp_path / "akn"))
    assert sorted(tuple(r) for r in assemble.read(spark, str(tmp_path / "akn")).collect()) == sorted((r.file, r.xml) for r in rows.values())


def test_commands(spark, tmp_path, capsys):
    """A known treaty's file is converted and indexed, others are left out; what was written is valid, a broken copy is not."""
    import json

    from lexplane import commands
    from lexplane.sources import treaties

    html = tmp_path / "html"
    html.mkdir()
    text = "<h1>Nairobi Treaty</h1><p>of September 26, 1981</p><p>The States</p><p><b>Article 1 : Scope</b></p><p>(1) One</p><p>(2) Two</p>"
    for name in ("1981_Nairobi_clean.html", "other.html", "_1981_Nairobi_clean.html"):
        (html / name).write_text(text)
    out = str(tmp_path / "out")
    assert commands.main(["convert", str(html), out]) == 0
    assert capsys.readouterr().out == "1981_nairobi_clean.xml: 1 articles, 2 paragraphs, 1 lines of preamble\n"
    assert [(r.file, r.work_uri) for r in treaties.read_index(spark, f"{out}/index").collect()] == [("1981_nairobi_clean.xml", "/akn/un/act/treaty/wipo/1981-09-26/nairobi")]
    assert commands.main(["validate", f"{out}/akn", f"{out}/report"]) == 0
    assert capsys.readouterr().out == "1 files: 1 valid, 0 invalid\n"
    assert json.loads(spark.read.text(f"{out}/report").first().value)["doc"] == "1981_nairobi_clean.xml"
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.xml").write_text("<act><body><article eId='x'/><article eId='x'/></body></act>")
    assert commands.main(["validate", str(bad), f"{out}/report2"]) == 1
