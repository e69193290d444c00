import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lexplane.llm import labelled, op1_lines, op3_mixing, op7_ordinal, op8_toxicity, op9_bpe, op10_simhash
from lexplane.llm.common import Scratch


def corpus(n=900):
    """Prose, a tenth of it toxic by ten words or a family of words, a tenth of it junk; near copies and shared lines."""
    r = random.Random(8)
    syllables = ["ra", "to", "li", "men", "sou", "ke", "bri", "da", "fo", "nu"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    insults = ["grubby", "vile", "fool", "dolt", "louse"]
    docs, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(r.randrange(8, 90))]
        toxic, quality = i % 10 == 3, i % 10 != 7
        if toxic:
            for _ in range(3):
                ws[r.randrange(len(ws))] = r.choice(insults) if i % 20 == 3 else "zzork" + word()
        text = " ".join(ws if quality else [w.upper() + "***" for w in ws])
        if i % 3 == 0:
            text += "\nRead more on our site"
        docs.append((i, text, "en", f"src{i % 4 if i % 3 else 0}", len(text)))
        labels.append((i, int(quality), int(toxic)))
    docs += [(n + k, docs[k][1], "en", "src1", docs[k][4]) for k in range(40)]
    docs += [(2000, None, "en", None, None), (2001, "", None, "src1", 0), (None, "grubby fool " * 9, None, None, None), (2002, "grubby vile fool " * 30_000, "en", "src9", 1), (5, docs[5][1], "en", "src1", 0)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int"), labels


def test_held_out_split(tables):
    docs, _, _ = tables
    for x in docs.where("doc_id is not null").select("doc_id", labelled.held_out(docs.doc_id).alias("h")).collect():
        assert x.h == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2)


def test_toxicity_on_held_out_rows(tables):
    docs, labels, truth = tables
    got = op8_toxicity.score(docs, op8_toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    toxic = {i: t for i, _, t in truth}
    seen = [(x.predicted, toxic[x.doc_id]) for x in got if x.held_out and x.doc_id in toxic]
    hit = sum(p and t for p, t in seen)
    assert hit >= 0.9 * sum(t for _, t in seen) and sum(p and not t for p, t in seen) <= 0.02 * len(seen)
    assert next(x for x in got if x.doc_id == 2002).predicted == 1


def test_toxicity_learns_nothing_from_held_out_labels(spark, tables):
    docs, labels, _ = tables
    lying = labels.withColumn("toxic", labelled.held_out(labels.doc_id).cast("int")).where(labelled.held_out(labels.doc_id))
    assert op8_toxicity.train(docs, lying).lexicon == {}
    assert op8_toxicity.score(docs.limit(0), op8_toxicity.Toxicity()).count() == 0
    assert {x.predicted for x in op8_toxicity.score(docs, op8_toxicity.Toxicity()).collect()} == {0}


def test_label_model_finds_accuracies_and_repeats():
    """Of voters with known accuracies the better ones have larger log odds, and copies of a voter share its weight."""
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.2
    n = 2 * len(op8_toxicity.KINDS)
    v = np.full((4000, n + 4), -1)
    for j, acc in enumerate((0.95, 0.9, 0.7)):
        v[:, j] = np.where(r.random(4000) < acc, y, ~y)
    v[:, 3] = v[:, 4] = v[:, 1]
    post, odds, weight = op8_toxicity.label_model(v, 0.2)
    assert odds[0, 2] > odds[2, 2] > 0
    assert weight[3] < 0.5 and weight[0] > 0.7
    assert ((post > 0.5) == y).mean() > 0.9


def test_ordinal_regression_orders_grades(tables):
    docs, labels, truth = tables
    model = op7_ordinal.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = op7_ordinal.classify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x.expected_grade <= 2 and x.kept == (x.tail_probability >= 0.3) for x in got)
    good = {i: q for i, q, _ in truth}
    seen = [(x.kept, good[x.doc_id]) for x in got if x.doc_id in good and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert np.mean([k == bool(q) for k, q in seen]) > 0.97
    assert op7_ordinal.classify(docs.limit(0), op7_ordinal.fit([])).count() == 0


def test_ordinal_regression_learns_from_whole_texts(spark):
    """Rows that differ only in the last of thousands of distinct words are told apart."""
    filler = " ".join(f"f{k}" for k in range(6000))
    docs = spark.createDataFrame([(n, f"{filler} {'good' if n % 2 else 'poor'}") for n in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(60)], "doc_id long, quality int, toxic int")
    got = {x.doc_id % 2: x.tail_probability for x in op7_ordinal.classify(docs, op7_ordinal.train(docs, labels)).collect()}
    assert got[1] > got[0] + 0.01


def test_ordinal_gradient():
    """The fit recovers thresholds and weights of a simulated cumulative-link model."""
    r = np.random.default_rng(2)
    x = r.random(5000)
    u = 1 / (1 + np.exp(-(4 * x[:, None] - np.array([1.0, 3.0])[None, :])))
    y = np.array([(v < p).sum() for v, p in zip(r.random(5000), u, strict=True)])
    model = op7_ordinal.fit([([5], [float(v)], int(k)) for v, k in zip(x, y, strict=True)], steps=800, l2=0.0)
    assert abs(model.weights[5] - 4) < 0.4 and np.abs(model.thresholds - [1, 3]).max() < 0.3


def test_pipeline_against_brute_force(spark, tables, tmp_path):
    docs, labels, _ = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # toxicity
    model, rows = op8_toxicity.train(docs, labels), [tuple(x) for x in docs.collect()]
    rows = [x for x in rows if model.score(x[1] or "", {}) < 0.3]
    assert 700 < len(rows) < 900
    # lines
    totals, seen = Counter(x[3] for x in rows), Counter()
    for x in rows:
        for line in {y.strip(" \t\n\x0b\x0c\r") for y in (x[1] or "").split("\n")} - {""}:
            seen[x[3], line] += 1
    bad = {k for k, c in seen.items() if c >= 3 and c > 0.1 * totals[k[0]]}
    assert bad
    clean = []
    for x in rows:
        if x[1] is not None:
            ls = x[1].split("\n")
            kept = [y for y in ls if (x[3], y.strip()) not in bad]
            text = x[1] if len(kept) == len(ls) else "\n".join(kept)
            x = (x[0], text, x[2], x[3], len(text))
        clean.append((*x[:4], None if x[1] is None else x[4]))
    # near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more
    known = sorted({(x[0], x[1]) for x in clean if x[0] is not None}, key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    sets, parent = [set(op10_simhash.shingles(t, 5).tolist()) for _, t in known], list(range(len(known)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    number, first, kept = {x: n for n, x in enumerate(known)}, set(), []
    for x in clean:
        if x[0] is None or find(n := number[x[0], x[1]]) == n and n not in first:
            first |= set() if x[0] is None else {n}
            kept.append(x)
    assert len(clean) - len(kept) >= 30
    assert len(kept) < len(clean)
    # mix and tokens
    frame = spark.createDataFrame(kept, docs.schema)
    scratch = Scratch(spark, "test")
    copies = defaultdict(int)
    for x in op3_mixing.decisions(scratch, frame).collect():
        copies[x.doc_id] += x.copies
    bpe, want = op9_bpe.speculator(*op9_bpe.default_vocab()), Counter()
    for x in kept:
        ids = bpe.encode_all([x[1] or ""])[0]
        if copies[x[0]]:
            want[x[0], len(ids)] += copies[x[0]]
    assert Counter((k[0], k[1]) for k in got.elements()) == want


def test_rows_that_repeat_an_id(spark, tmp_path):
    """Of ids 1, 3, 3, where one row 3 copies row 1, row 1 and the other row 3 stay; of equal rows one."""
    text, other = "a text of some more than five words in all", "quite another text with some words of its own"
    rows = [(1, text, "en", "a", 1), (3, text, "en", "a", 1), (3, other, "de", "b", 2), (3, other, "de", "b", 2), (None, text, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4]], key=str)


def test_operators_with_clashing_columns(spark, tables):
    docs, labels, _ = tables
    more = docs.select("*", *[docs.doc_id.alias(c) for c in ("y", "id", "__id", "__scored", "toxic", "score")])
    model = op8_toxicity.train(more, labels)
    assert model.lexicon and op8_toxicity.keep_clean(more, model).columns == more.columns
    assert op7_ordinal.classify(more, op7_ordinal.train(more, labels)).count() == docs.count()


def test_stages_keep_the_columns(spark, tables, tmp_path):
    docs, labels, _ = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    extra = docs.select("*", *[docs.doc_id.alias(c) for c in ("size", "score", "y", "id", "__id", "__scored", "__bad", "__kept", "row", "tie", "cls")]).limit(50)
    for frame in (extra, extra.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = Scratch(spark, "t").table(stage(spark, frame, str(tmp_path)), name)
            assert frame.columns == extra.columns
    assert op1_lines.drop_boilerplate(Scratch(spark, "t"), extra).count() == 50


def test_tasks_give_their_memory_back(monkeypatch):
    """After its last batch, and when it is closed before: a reused worker has no freed memory of an earlier stage."""
    import pyarrow as pa

    from lexplane.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batches = [pa.record_batch([pa.array(range(5))], ["n"])] * 2
    run = common.in_batches(lambda found: found, 2)
    assert [b.num_rows for b in run(iter(batches))] == [2, 2, 1] * 2 and calls == [1]
    begun = run(iter(batches))
    next(begun)
    begun.close()
    assert calls == [1, 1]
