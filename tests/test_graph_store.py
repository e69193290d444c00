"""Stored graphs without shuffles, Turtle there and back, structural joins and names against plain searches."""

import random
import re

from pyspark.sql import functions as F

from lexplane.functions.automaton import Names
from lexplane.operators import locate, stored, structural, turtle
from lexplane.operators import triples as G
from lexplane.sources import akn, treaties

TRIPLES = "s string, p string, o string, o_kind string, o_type string"
HARD = ['plain', 'say "so"', "back\\slash", "line\nend", "tab\t.\n", "a ; b , c . d # e <f> ^^g @h", "", "'", "\\n", "Ünï 🎉", "true", "5"]


def hard(spark):
    rows = [("ex:N1", "legal:note", t, "literal", "string") for t in HARD]
    rows += [("ex:N1", "rdf:type", "ipronto:ExploitationRight", "uri", ""), ("ex:N1", "legal:year", "70", "literal", "integer"), ("ex:N1", "legal:day", "2020-01-02", "literal", "date"), ("ex:N1", "legal:ok", "true", "literal", "boolean")]
    rows += [("nation_1", "name", "x", "literal", "string"), ("odd name<>", "p q", "ex:a b", "uri", ""), ("ex:a.b", "legal:x", "ex:-1", "uri", ""), ("50%+1", "legal:x", "y%20z", "uri", "")]
    rows += [("ex:hub", "legal:x", f"ex:n{n}", "uri", "") for n in range(2500)]
    return spark.createDataFrame(rows, TRIPLES)


def test_turtle_there_and_back(spark, tmp_path):
    graph = hard(spark)
    turtle.write(graph, str(tmp_path / "t"))
    for whole in (False, True):
        assert sorted(turtle.read(spark, str(tmp_path / "t"), whole=whole).collect()) == sorted(graph.distinct().collect())
    lines = [r.value for r in turtle.to_turtle(graph).collect()]
    hubs = [x for x in lines if x.startswith("ex:hub")]
    assert 3 <= len(hubs) <= 4 and sum(x.count("ex:n") for x in hubs) == 2500
    one = next(x for x in lines if x.startswith("ex:N1 "))
    assert one.startswith('ex:N1 a ipronto:ExploitationRight ;') and '"70"^^xsd:integer' in one


def test_foreign_turtle(spark):
    """Other prefixes for the same names, comments, SPARQL's directives, numbers, truth, long literals, languages, lists left out."""
    text = """# a comment with a <tag> and "quotes" .
@prefix l: <http://example.org/legal#> . PREFIX x: <http://example.org/resource/>
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>.
x:A a l:Rule ; l:years 50, 70 ; l:rate 1.5 ; l:ok true ; # inside; here
  l:text \"\"\"two
lines .
here\"\"\"@en .
<http://example.org/resource/B> <http://else.org/p> <http://else.org/o>, 'single'.
x:C l:list ( 1 2 ) .
"""
    got = {tuple(r) for r in turtle.statements(spark.createDataFrame([(text,)], "value string")).collect()}
    lit = lambda p, o, t: ("ex:A", p, o, "literal", t)
    assert got == {
        ("ex:A", "rdf:type", "legal:Rule", "uri", ""), lit("legal:years", "50", "integer"), lit("legal:years", "70", "integer"), lit("legal:rate", "1.5", "decimal"), lit("legal:ok", "true", "boolean"), lit("legal:text", "two\nlines .\nhere", "string"),
        ("ex:B", "http://else.org/p", "http://else.org/o", "uri", ""), ("ex:B", "http://else.org/p", "single", "literal", "string"),
    }


def test_stored_graph_needs_no_shuffle(spark, tmp_path):
    graph = hard(spark)
    kept = stored.store(graph, "lexplane_test_graph", str(tmp_path / "g"), 4)
    try:
        arms = G.star(kept, {"year": "legal:year"}, {"note": "legal:note"})
        around = G.subgraph(kept, [arms])
        ordered = stored.in_order(kept)
        for df in (arms, around, ordered):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan, plan
        assert sorted(kept.collect()) == sorted(graph.distinct().collect())
        assert around.count() == graph.where("s = 'ex:N1'").count()
        seen = [(r.s, r.p, r.o) for r in ordered.collect() if r.s == "ex:hub"]
        assert seen == sorted(seen)
    finally:
        spark.sql("DROP TABLE lexplane_test_graph")


def tree(r, pre, depth):
    """Rows (pre, post, token) of a random tree."""
    rows, at = [], pre + 1
    for _ in range(r.randrange(4) if depth else 0):
        below = tree(r, at, depth - 1)
        rows += below
        at = below[0][1] + 1
    return [(pre, at - 1, r.choice("12ab")), *rows]


def test_structural_joins(spark):
    r = random.Random(2)
    trees = {f"d{n}": tree(r, 0, 5) for n in range(30)}
    nodes = [(d, a, b, f"{d}:{a}", t) for d, rows in trees.items() for a, b, t in rows]
    asked = [(d, f"q{n}", *rows[k][:2], f"{d}:{rows[k][0]}", [r.choice("12ab") for _ in range(r.randrange(6))]) for d, rows in trees.items() for n in range(20) for k in [r.randrange(len(rows))]]

    def plain(d, pre, post, eid, tokens):
        for t in tokens:
            inside = sorted(x for x in trees[d] if pre < x[0] <= post and x[2] == t)
            if not inside:
                break
            pre, post, eid = inside[0][0], inside[0][1], f"{d}:{inside[0][0]}"
        return eid

    df = spark.createDataFrame(nodes, "doc string, pre int, post int, eid string, token string").repartition(5)
    got = {(x.doc, x.id): x.eid for x in structural.descend(spark.createDataFrame(asked, "doc string, id string, pre int, post int, eid string, tokens array<string>"), df).collect()}
    assert got == {(d, q): plain(d, a, b, e, t) for d, q, a, b, e, t in asked}
    pairs = structural.contained(df.select("doc", "pre", "post"), df.select("doc", F.col("pre").alias("pre_in")))
    want = sorted((d, a, b, x) for d, rows in trees.items() for a, b, _ in rows for x, _, _ in rows if a < x <= b)
    assert sorted((x.doc, x.pre, x.post, x.pre_in) for x in pairs.collect()) == want


def test_five_levels(spark):
    xml = '<act><body><article eId="a"><num>Article 1</num><paragraph eId="p1"><num>(1)</num></paragraph><paragraph eId="p2"><num>(2)</num><point eId="x"><num>(a)</num><point eId="y"><num>(i)</num><point eId="z"><num>(A)</num><point eId="w"><num>(1)</num></point></point></point></point></paragraph></article></body></act>'
    nodes = akn.nodes(spark.createDataFrame([("d", xml)], "doc string, xml string"))
    asked = {"Art. 1(2)(a)(i)(A)(1)": "w", "Art. 1(2)(a)(i)(A)": "z", "Art. 1(2)(b)(i)": "p2", "Art. 1": "a", "Art. 1(9)": "a", "Art. 7": ""}
    got = locate.find(spark.createDataFrame([("d", k) for k in asked], "doc string, ref string"), nodes)
    assert {x.ref: x.eid for x in got.collect()} == asked


def test_names_equal_the_patterns():
    r = random.Random(1)
    names = [*treaties.ALIASES, "a b a", "ab", "b", "a-b", "é", "K"]
    found = Names(names)
    parts = [*names, "a", "b", " ", "-", "/", "_", "x", "É", "K", "ſ", "İ", "PaRiS cOnVeNtIoN", "WCTs", "pct", "ß", "."]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        want = sorted((m.start(), m.end(), n) for n in found.names for m in re.finditer(rf"(?<![\w/]){re.escape(n)}(?![\w-])", text, re.I))
        assert sorted(found.find(text)) == want, text


def test_many_names_cost_what_few_do():
    import time

    text = "The parties to the Berne Convention and others agree. " * 4000
    few, many = Names(treaties.ALIASES), Names([*treaties.ALIASES, *(f"Treaty of City Number {n}" for n in range(10_000))])
    took = []
    for names in (few, many):
        list(names.find(text[:1000]))
        began = time.perf_counter()
        assert sum(1 for _ in names.find(text)) == 4000
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0] + 0.2
