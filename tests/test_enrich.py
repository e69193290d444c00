"""Marks spliced into mixed content, enriched files and their guard, against the plain text and the elements that were there."""

import random
import re
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from lexplane import commands
from lexplane.operators import enrich
from lexplane.sources import files, markup

MARKS = "array<struct<start:long,end:long,open:string,again:string,close:string>>"


def mixed(r, n, depth=0):
    out = ""
    for _ in range(n):
        k = r.randrange(6)
        if k < 3:
            out += r.choice(["ab", "c &amp; d", "é🎉", "x", "&lt;"])
        elif k == 3:
            out += r.choice(["<br/>", "<!-- c -->"])
        elif depth < 3:
            tag = r.choice("iub")
            out += f"<{tag}>{mixed(r, r.randrange(4), depth + 1)}</{tag}>"
    return out


def covered(el):
    """Text positions below each mark, by its number."""
    found, at = {}, 0

    def walk(e, inside):
        nonlocal at
        own = [*inside, e.get("n") or e.get("again")] if e.tag == "m" else inside
        for text, marks in ((e.text, own), *[x for child in e for x in ((child, own), (child.tail, own))]):
            if isinstance(text, ET.Element):
                walk(text, marks)
                continue
            for _ in text or "":
                for k in marks:
                    found.setdefault(k, []).append(at)
                at += 1

    walk(el, [])
    return found


def test_splice_nests(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(f"d{n}", f"<act><body><p>{mixed(r, 6)}</p></body></act>") for n in range(150)], "doc string, xml string")
    paragraphs = markup.parts(docs).where("kind = 'p'").cache()
    marks = []
    for row in paragraphs.collect():
        cuts = sorted(r.sample(range(len(row.text) + 1), min(len(row.text) + 1, 2 * r.randrange(4))))
        marks.append((row.doc, [(a, b, f'<m n="{k}">', f'<m again="{k}">', "</m>") for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=False))]))
    both = paragraphs.join(spark.createDataFrame(marks, f"doc string, marks {MARKS}"), "doc")
    for row in both.select("text", "xml", "marks", enrich.splice(F.col("text"), F.col("events"), F.col("marks")).alias("out")).collect():
        el = ET.fromstring(f"<p>{row.out}</p>")
        assert "".join(el.itertext()) == row.text
        assert ET.canonicalize("<p>" + re.sub("</?m[^>]*>", "", row.out) + "</p>") == ET.canonicalize(f"<p>{row.xml}</p>")
        assert covered(el) == {str(k): list(range(m.start, m.end)) for k, m in enumerate(row.marks)}


def test_parts_are_the_text(spark):
    texts = ['<?xml version="1.0"?>\n<a:act xmlns:a="u"><a:meta><a:references source="#x" y="&lt;"><a:TLCTerm eId="t" showAs="T"/></a:references></a:meta><a:body><a:p>x</a:p><a:p/> <a:p>y<a:note><a:p>z</a:p></a:note></a:p></a:body></a:act>', "<act><body/></act>", "<broken", ""]
    rows = markup.parts(spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)] + [("null", None)], "doc string, xml string")).collect()
    join = lambda n: "".join(r.xml for r in sorted(rows, key=lambda r: r.ord) if r.doc == n and r.xml is not None)
    assert join("0") == texts[0].replace('<a:references source="#x" y="&lt;">', "").replace("</a:references>", "")
    assert [join(n) for n in "123"] == texts[1:] and {r.kind for r in rows if r.doc in "23"} == {"broken"}
    assert not any(r.doc == "null" for r in rows) and [r.text for r in rows if r.kind == "p"] == ["x", "", "yz"]


def test_command_enriches_a_folder(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    head = '<act><meta><identification><FRBRWork><FRBRuri value="/akn/paris"/></FRBRWork></identification></meta>'
    (source / "a.xml").write_text(head + '<preamble><p>Article 2</p></preamble><body><article eId="art_2"><p>“Stra<i>ße</i>” means a &amp; b under <b>the Par</b>is Convention</p><p>"STRASSE" means x</p></article></body></act>')
    (source / "b.xml").write_text("<broken")
    (source / "_c.xml").write_text("<act/>")
    assert commands.main(["enrich", str(source), str(out)]) == 2
    lines = capsys.readouterr().out.split("\n")
    assert lines[0] == "OK a.xml, 0.00 % of text changed: 2 definitions, 1 internal and 1 external references"
    assert lines[2].startswith("2 files, 1 failed: 2 definitions")
    assert (out / "b.xml").read_text() == "<broken" and not (out / "_c.xml").exists()
    el = ET.fromstring((out / "a.xml").read_text())
    assert [(d.get("eId"), d.get("refersTo")) for d in el.iter("def")] == [("def_term_strae_1", "#term_strae"), ("def_term_strae_2", "#term_strae")]
    assert [(x.get("href"), "".join(x.itertext())) for x in el.iter("ref")] == [("#art_2", "Article 2"), ("/akn/paris", "Par"), ("/akn/paris", "is Convention")]
    assert el.find(".//references").get("source") == "#wipo" and [t.get("showAs") for t in el.iter("TLCTerm")] == ["Straße"]
    empty = tmp_path / "none"
    empty.mkdir()
    assert commands.main(["enrich", str(empty), str(out / "x")]) == 1


def test_guard_on_both_sides(spark):
    """One changed word in a long text passes, more than one percent is reverted; the bound never lies below the ratio."""
    import difflib

    text = "the quick brown fox jumps over the lazy dog " * 12
    rows = [("same", text, text), ("little", text[:176], text[:176].replace("quick", "quack", 1)), ("much", text, text.replace("quick", "slow")), ("half", text, text[:200]), ("empty", "", ""), ("none", None, "x"), ("turned", text, text[::-1])]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    got = {r.id: (r.d, r.bound) for r in enrich.with_delta(df, F.col("a"), F.col("b"), name="d").withColumn("bound", enrich.similarity_bound(F.col("a"), F.col("b"))).collect()}
    for name, a, b in rows:
        want = difflib.SequenceMatcher(None, " ".join((a or "").split()), " ".join((b or "").split())).ratio() if a or b else 1.0
        assert got[name][1] >= want - 1e-9
        assert (got[name][0] > 1) == ((1 - want) * 100 > 1), name
    docs = spark.createDataFrame([(n, f"<act><body><p>{a}</p></body></act>", f"<act><body><p>{b}</p></body></act>") for n, a, b in rows if a], "doc string, old string, new string")
    original = docs.select("doc", F.col("old").alias("xml"), F.col("old").cast("binary").alias("content"))
    found = enrich.checked(docs.select("doc", F.col("new").alias("xml"), F.lit(False).alias("broken")), original).collect()
    assert {r.doc: r.status for r in found} == {"same": "OK", "little": "OK", "much": "REVERTED", "half": "REVERTED", "turned": "REVERTED"}
    assert all((b"slow" in r.content) is False for r in found)


def test_files_once(spark, tmp_path):
    import pytest

    rows = spark.createDataFrame([("a", b"1"), ("a", b"2")], "file string, content binary")
    with pytest.raises(ValueError, match="2 times"):
        files.write(rows, str(tmp_path / "x"))
