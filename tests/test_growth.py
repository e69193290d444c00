"""Plans that must not depend on how small a compressed table looks: no guessed broadcasts, work dealt over all cores, nodes read once."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexplane.functions.text import normalize_space
from lexplane.operators import schema, structural, validate
from lexplane.plans import queries
from lexplane.plans.registry import QUERIES
from lexplane.sources import akn, files, html, markup


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", "enriched_documents enriched_totals treaty_documents convert_counters convert_nodes convert_totals deep_citation locate_citation source_text reverted_documents passage_text".split())
def test_documents_are_not_broadcast(spark, name):
    plan = _plan(QUERIES[name](spark, entry.SF))
    assert "Join" not in plan or "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("table", ["_akn", "_filed", "_part_rules"])
def test_rows_are_dealt_before_they_unfold(spark, table):
    assert getattr(queries, table)(spark, entry.SF).rdd.getNumPartitions() >= 32


@pytest.mark.parametrize("name", "akn_counts bgp_star_duration convert_nodes deep_citation document_texts enriched_documents frbr_fields html_entries national_sections paragraph_order passage_text render_document reverted_documents schema_report valid_report valid_summary".split())
def test_queries_deal_their_rows(spark, name):
    assert "REPARTITION_BY_NUM" in _plan(QUERIES[name](spark, entry.SF))


def test_frbr_reads_nodes_once(spark):
    docs = spark.createDataFrame([("d", '<a><FRBRWork><FRBRuri value="w"/></FRBRWork><FRBRExpression><FRBRuri value="e"/></FRBRExpression><FRBRuri value="x"/></a>'), ("e", "<a/>")], "doc string, xml string")
    found = akn.frbr(akn.nodes(docs))
    assert _plan(found).count("MapInArrow") == 1
    assert [(r.doc, r.work_uri) for r in found.collect()] == [("d", "w")]


def test_contained_across_batches(spark):
    """Nested intervals whose stream is cut into batches of three rows, against all pairs."""
    rng, outer, inner = random.Random(3), [], []
    for doc in (f"d{k}" for k in range(7)):
        parents = [(0, 40), (1, 20), (2, 9), (10, 20), (21, 40), (22, 22), (30, 35)]
        outer += [(doc, a, b) for a, b in parents]
        inner += [(doc, rng.randrange(-2, 45), n) for n in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = structural.contained(spark.createDataFrame(outer, "doc string, pre int, post int"), spark.createDataFrame([*inner, (None, 1, 1), ("d1", None, 1)], "doc string, pre_in int, n int"))
        rows = sorted((r.doc, r.pre, r.post, r.pre_in, r.n) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == sorted((d, a, b, p, n) for d, a, b in outer for e, p, n in inner if d == e and a < p <= b)
    assert got.select(F.count("*")).first()[0] == len(rows) > 0


ODD = [
    '<a eId="a">x<meta eId="m">y<p eId="p">z<authorialNote eId="n">q<b eId="bb">r</b>s</authorialNote>t</p>u</meta>v<p eId="k">1<ref>2<references>3<num>4</num></references>5</ref>6</p></a>',
    "<a xml:id='1' id='2' eId=''><num/><num>2</num>t<!-- c -->u<?pi x?>v<![CDATA[w]]></a>", "<!DOCTYPE a [<!ENTITY x 'y<b eId=\"e\"/>'>]><a eId='r'>1&x;2</a>", "<!DOCTYPE a SYSTEM 'x'><a>&foo;</a>", "<a", "", None,
]


def test_nodes_make_wanted_columns_only(spark):
    """Some columns are the same as those of the whole table, also inside skipped elements; children are their names in order."""
    docs = spark.createDataFrame([(f"d{n}", x) for n, x in enumerate(ODD)], "doc string, xml string")
    whole = akn.nodes(docs)
    some = akn.nodes(docs, ["doc", "pre", "content", "children"])
    assert some.columns == ["doc", "pre", "content", "children"]
    rows = sorted(some.collect())
    assert [tuple(r)[:3] for r in rows] == sorted(tuple(r) for r in whole.select("doc", "pre", "content").collect())
    assert [(r.content, r.children) for r in rows if r.doc == "d0"] == [("xv1256", "meta p"), ("", "p"), ("zt", "authorialNote"), ("", "b"), ("r", ""), ("1256", "ref"), (None, "references"), (None, "num"), (None, "")]
    assert {r.doc for r in rows} == {"d0", "d1", "d2"}


@pytest.mark.parametrize("name, columns", [("akn_counts", "doc tag"), ("passage_text", "doc pre eid content"), ("valid_report", "doc pre parent tag eid attrs"), ("valid_summary", "doc pre parent tag eid attrs")])
def test_queries_make_the_columns_they_read(spark, name, columns):
    made = re.findall(r"MapInArrow run\([^)]*\)#\d+, \[([^\]]*)\]", _plan(QUERIES[name](spark, entry.SF)))
    assert [[c.split("#")[0].strip() for c in x.split(",")] for x in made] == [columns.split()]


def test_schema_is_checked_in_the_pass_that_reports(spark):
    """One reading of the texts; with and without children beside the nodes the errors are the same."""
    assert _plan(QUERIES["schema_report"](spark, entry.SF)).count("MapInArrow") == 1
    docs = spark.createDataFrame([("a", '<act><body/><meta/></act>'), ("b", "<p/>"), ("c", '<body><article><num/><heading/></article><article eId="x"><heading/><num/></article></body>')], "doc string, xml string")
    some = akn.nodes(docs, {*validate.READ, *schema.READ})
    want = sorted(schema.errors(akn.nodes(docs)).collect())
    assert sorted(schema.errors(some).collect()) == want and [len(r.schema_errors) for r in want] == [4, 0, 2]
    assert sorted(validate.report(schema.marked(some)).select("doc", "schema_errors").collect()) == want


def test_plain_html_is_read_as_the_parser_reads_it():
    rng = random.Random(5)
    tokens = ["<p>", "</p>", "<P>", "<b>", "</b >", "<ul>", "</ul>", "<table>", "</table>", "<br>", "<br/>", '<div class="a">', "<div a=b>", '<p a="x>y">', '</p x="y">', "text ", " &amp; x", "&am", "p;", "&lt", "<!-- c -->", "<?x?>", "<script>", "</script>", "<", "<3", ">", "\u200b", "</", "<title>", "<p\x0b>", "<p\x0c>", "<p-x>", "<scriptx>", "<plaintext>"]
    for _ in range(3000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randrange(12)))
        parser = html._Entries()
        parser.feed(text)
        parser.close()
        parser.close_p()
        assert html._rows(text) == parser.rows, text
    calls, feed = [], html._Entries.feed
    html._Entries.feed = lambda self, x: calls.append(x)
    try:
        assert html._rows('<div><p class="a">a &amp; <b>bold</b><p>c</div>') == [("a & bold", 0, 4, False), ("c", 0, 0, False)] and not calls
    finally:
        html._Entries.feed = feed


def test_entries_are_one_line_as_normalize_space_makes_them(spark):
    spaces = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200F), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
    texts = [f"{c}a{c}{c}b{c}" for c in spaces]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_space(F.col("t"))).collect()
    assert [r[0] for r in rows] == [html._one_line(t) for t in texts]


MIXED = ["<act><meta/><preamble><p>a <b>c</b></p></preamble><body><p eId='x'>d</p><p/></body></act>", "<p>outside</p>", "<broken", None, "", "<act><body>" + "<p>e</p>" * 5000 + "</body></act>"]


def test_parts_of_many_documents_share_batches(monkeypatch):
    """The rows of each document are those that it has alone, whatever batch they are in."""
    docs = [(f"d{n}", MIXED[n % len(MIXED)]) for n in range(60)]
    given = lambda: iter([pa.RecordBatch.from_pylist([{"doc": d, "xml": x} for d, x in docs])])
    want = [{"doc": d, **dict(zip(markup._ARROW.names[1:], (n, *row), strict=True))} for d, x in docs if x is not None for n, row in enumerate(markup.cut(x))]
    for rows, characters in ((4096, 1 << 22), (7, 1 << 22), (4096, 100)):
        monkeypatch.setattr(markup, "ROWS", rows)
        monkeypatch.setattr(markup, "CHARACTERS", characters)
        got = list(markup.cut_all(given()))
        assert [r for b in got for r in b.to_pylist()] == want and max(b.num_rows for b in got) <= rows
    monkeypatch.undo()
    few = [pa.RecordBatch.from_pylist([{"doc": f"d{n}", "xml": MIXED[0]} for n in range(200)])]
    assert len(list(markup.cut_all(iter(few)))) == 1
    some = pa.schema([markup._ARROW.field(c) for c in ("doc", "pos", "text")])
    assert [r for b in markup.cut_all(given(), some, {"p"}) for r in b.to_pylist()] == [{c: r[c] for c in some.names} for r in want if r["kind"] == "p"]


def test_paragraph_order_makes_the_columns_it_reads(spark):
    made = re.findall(r"MapInArrow [^\n]*?, \[([^\]]*)\]", _plan(QUERIES["paragraph_order"](spark, entry.SF)))
    assert [[c.split("#")[0].strip() for c in x.split(",")] for x in made] == [["doc", "pos", "text"]]


def test_document_text_parses_once(spark):
    texts = ["<a><body>b <x>c</x></body><preface>&amp;p</preface></a>", "<a><preamble>q</preamble><body>1</body><body>2</body></a>", "<a/>", "<n:body xmlns:n='u'>n<![CDATA[<z>]]></n:body>", "", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", markup.document_text(F.col("t")).alias("t"))
    assert [r.t for r in sorted(df.collect())] == ["&p b c", "q 1", "", "n<z>", "", ""]
    assert _plan(QUERIES["document_texts"](spark, entry.SF)).count("XPathStringEvaluator(") == 1


def test_files_are_read_by_their_manifest(spark, tmp_path):
    """The same as the folder read by Spark, bytes that are no UTF-8 among them, without a scan of it; a file that is gone is an error."""
    given = {"a.html": b"<p>\r\na\n</p>\n", "b.html": "\ufeffb \u00e9".encode(), "c é.html": b"\xff\xfe\x00c", "_d.html": b"x"}
    manifest = files.write(spark.createDataFrame(list(given.items()), "file string, content binary"), str(tmp_path))
    found = lambda df: sorted((r.doc, bytes(r.x)) for r in df.select("doc", F.col("xml").cast("binary").alias("x")).collect())
    got = files.texts(manifest, str(tmp_path))
    assert found(got) == sorted((k, v) for k, v in given.items() if k[0] != "_")
    assert found(got.where("doc in ('a.html', 'b.html')")) == found(akn.read_texts(spark, str(tmp_path)).where("doc in ('a.html', 'b.html')"))
    (tmp_path / "a.html").unlink()
    with pytest.raises(Exception, match="a.html"):
        got.collect()
    plan = _plan(QUERIES["html_files"](spark, entry.SF))
    assert "REPARTITION_BY_NUM" in plan and "FileScan text" not in plan and "Scan text" not in plan
