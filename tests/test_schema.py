"""Content models against a plain check of each element, and whole converted documents."""

import re
import xml.etree.ElementTree as ET

from lexplane.operators import schema, validate
from lexplane.sources import akn

META = '<meta><identification source="#s">{w}<FRBRExpression><FRBRthis value="a"/><FRBRuri value="a"/><FRBRdate date="d" name="n"/><FRBRauthor href="#h"/><FRBRlanguage language="eng"/></FRBRExpression><FRBRManifestation><FRBRthis value="a"/><FRBRuri value="a"/><FRBRdate date="d" name="n"/><FRBRauthor href="#h"/></FRBRManifestation></identification>{r}</meta>'
WORK = '<FRBRWork><FRBRthis value="a"/><FRBRuri value="a"/><FRBRdate date="d" name="n"/><FRBRauthor href="#h"/><FRBRcountry value="un"/></FRBRWork>'
BODY = '<body><article eId="a"><num>1</num><heading>h</heading><content><p>x</p></content></article></body>'


def doc(w=WORK, r='<references source="#s"/>', body=BODY, name=' name="a"'):
    return f"<akomaNtoso><act{name}>{META.format(w=w, r=r)}{body}</act></akomaNtoso>"


CASES = {
    "good": (doc(), []),
    "no name": (doc(name=""), ["act[1]: attribute name is missing"]),
    "no work": (doc(w=""), ["identification[3]: children FRBRExpression FRBRManifestation do not fit"]),
    "twice": (doc(w=WORK * 2), ["identification[3]: children FRBRWork FRBRWork FRBRExpression FRBRManifestation do not fit"]),
    "empty body": (doc(body="<body/>"), ["body[22]: children  do not fit"]),
    "misplaced": (doc(body='<body><article eId="a"><heading>h</heading><num>1</num><content><p>x</p></content></article></body>'), ["article[a]: children heading num content do not fit"]),
    "no id": (doc(body='<body><chapter><num>I</num><article eId="a"><content><p>x</p></content></article></chapter></body>'), ["chapter[23]: attribute eId is missing"]),
    "term": (doc(r='<references source="#s"><TLCTerm eId="t" href="/t"/></references>'), ["TLCTerm[t]: attribute showAs is missing"]),
    "publication last": (doc(r='<references source="#s"/><publication date="d" name="n" showAs="s"/>'), ["meta[2]: children identification references publication do not fit"]),
}


def test_errors(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("broken", "<x")], "doc string, xml string")
    nodes = akn.nodes(docs).cache()
    got = {r.doc: r.schema_errors for r in schema.errors(nodes).collect()}
    want = {k: [re.sub(r"  ", " ", e) for e in v[1]] for k, v in CASES.items()}
    assert {k: [re.sub(r"\[\d+\]", "[n]", re.sub("  ", " ", e)) for e in v] for k, v in got.items()} == {k: [re.sub(r"\[\d+\]", "[n]", e) for e in v] for k, v in want.items()}
    valid = {r.doc: r.schema_errors for r in validate.report(nodes, schema.errors(nodes)).collect()}
    assert valid["good"] == [] and len(valid["twice"]) == 1


def test_models_against_a_plain_reading():
    """Every model's pattern, for the children that the models themselves allow and for those put in another order."""
    for name, model in schema.MODELS.items():
        pattern = re.compile(schema.compiled(model))
        first = [t for t in re.findall(r"\w+[?*+]?", model.split("(")[0])]
        needed = [t.rstrip("+") for t in first if t[-1] not in "?*"]
        rest = re.findall(r"\w+", model[len(model.split("(")[0]) :])[:1]
        children = [*needed, *rest]
        assert pattern.match("".join(f"{c} " for c in children)), name
        assert not pattern.match("".join(f"{c} " for c in [*children, "nothing"]))
        assert len(needed) < 2 or not pattern.match("".join(f"{c} " for c in reversed(children)))


def test_assembled_documents_fit(spark):
    from pyspark.sql import functions as F

    from lexplane.operators import assemble, convert
    from lexplane.sources import html

    text = "<h1>A</h1><p>of May 2, 1980</p><p>Parties</p><p>CHAPTER I : General</p><p><b>Article 1 : Scope</b></p><p>(1) a</p><p><b>Article 2</b></p><p>(1) Lead</p><p>(a) x</p><p>(i) y</p><p>(2) End</p>"
    docs = spark.createDataFrame([("t", text)], "doc string, html string")
    found = convert.blocks(html.entries(docs), docs.select("doc", html.title(F.col("html")).alias("title"))).cache()
    out = assemble.documents(found, convert.article_nodes(found), spark.createDataFrame([("t", "ab", "treaty", 1900)], "doc string, short_name string, kind string, year int")).cache()
    ET.fromstring(out.first().xml)
    assert schema.errors(akn.nodes(out.select("doc", "xml"))).first().schema_errors == []
