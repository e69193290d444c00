import random

import numpy as np
import xxhash

from lexplane.llm import op4_forest, op10_simhash
from lexplane.llm.common import connected_components


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_components(scratch, docs, rows):
    got = op10_simhash.near_duplicates(scratch, op10_simhash.fingerprints(docs)).collect()
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows]
    assert sorted(map(str, ((x.doc_id, x.fp % 2**64) for x in got))) == sorted(map(str, fps))
    known = sorted({x for x in fps if x[0] is not None})
    root = union(len(known), [(i, j) for i in range(len(known)) for j in range(i) if (known[i][1] ^ known[j][1]).bit_count() <= 2])
    want = {known[n][0]: known[root[n]][0] for n in range(len(known))}
    assert all(x.component_id == want.get(x.doc_id) for x in got)
    assert len(set(want.values())) < len(want)


def test_trie_against_all_pairs():
    r = np.random.default_rng(0)
    for n, spread in ((2, 64), (300, 12), (800, 64), (1000, 10)):
        base = r.integers(0, 1 << 63, 1, np.uint64)
        v = np.unique(base ^ r.integers(0, min(1 << spread, (1 << 63) - 1), n, np.uint64))
        i, j = op10_simhash.trie_pairs(v, np.array([0]), np.array([len(v)]))
        d = np.bitwise_count(v[:, None] ^ v[None, :])
        want = {(a, b) for a, b in zip(*np.nonzero(np.triu(d <= 2, 1)), strict=True)}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_large_tries_are_dealt_again(spark, scratch):
    """A dense cloud of fingerprints, in tries of at most 8, has the same components as by brute force."""
    r = random.Random(5)
    centre, fps = r.getrandbits(64), set()
    while len(fps) < 400:
        x = centre
        for _ in range(r.randrange(12)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(n, op10_simhash._signed(x)) for n, x in enumerate(fps)], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in op10_simhash.near_duplicates(scratch, df, most=8).collect()}
    root = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert [got[n] for n in range(len(fps))] == root


def test_fingerprints_of_empty_table(scratch, empty):
    assert op10_simhash.near_duplicates(scratch, op10_simhash.fingerprints(empty)).count() == 0


def test_components_of_chains_and_hubs(spark, scratch):
    r = random.Random(6)
    edges = [(n, n + 1) for n in range(300)] + [(1000, n) for n in range(1001, 1400)] + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(300)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in connected_components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = union(3000, [e for e in edges if None not in e])
    assert got == {n: root[n] for e in edges if None not in e and e[0] != e[1] for n in e}


def brute_links(rows, threshold=0.93):
    ok = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    out = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    out.append((i, j))
    return out


def vectors():
    r = np.random.default_rng(7)
    rows = []
    for n in range(500):
        v = r.standard_normal(16) if n % 3 else rows[-1 - n % 2 if rows else 0][1] + r.standard_normal(16) * 0.12 if n > 3 else r.standard_normal(16)
        rows.append((n, np.asarray(v, np.float32).astype(float), int(n % 2 == 0 or n > 300)))
    rows = [(a, v.tolist(), c) for a, v, c in rows]
    rows += [(900 + n, rows[10][1], rows[10][2]) for n in range(50)] + [rows[20], rows[20]]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] + [1.0] * 15, 1), (1003, [float("nan")] * 16, 1), (1004, rows[0][1], None), (1005, rows[0][1][:8], 1), (1006, [], 1), (1007, [float("inf")] * 16, 1), (1008, [1e30] * 16, 1), (1009, [1e-30] * 16, 1)]
    return rows


def test_forest(spark, scratch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "n")
    links = brute_links(rows)
    want = np.zeros(len(rows), int)
    for i, j in links:
        want[i] += 1
        want[j] += 1
    found = {}
    for leaf, levels in ((32, 40), (16, 2), (4096, 40)):  # splits; blocks of large leaves; one leaf
        got = op4_forest.near_duplicates(scratch, df, leaf=leaf, levels=levels).collect()
        assert len(got) == len(rows)
        by = {}
        for x in got:
            by.setdefault(x.vec_id, x)
        have = np.array([by[r[0]].n_links for r in rows])
        assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
        assert all(x.kept == (x.vec_id == x.component_id) for x in got)
        found[leaf] = have
    assert (found[4096] == want).all()
    root = union(len(rows), links)
    first = [min(rows[k][0] for k in range(len(rows)) if root[k] == root[n]) for n in range(len(rows))]
    assert [by[r[0]].component_id for r in rows] == first


def test_forest_keeps_the_links_of_a_dense_group(spark, scratch):
    """Default parameters, one label: a group of 2,000 distinct near vectors in a background twice its size."""
    r = np.random.default_rng(4)
    centre = r.standard_normal(64)
    group = centre / np.linalg.norm(centre) + r.standard_normal((2000, 64)) * np.sqrt(0.05 / 0.95 / 64)
    x = np.concatenate((group, r.standard_normal((4000, 64)))).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert want[:2000].min() > 500
    df = spark.createDataFrame([(n, v.tolist(), 0) for n, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {y.vec_id: y.n_links for y in op4_forest.near_duplicates(scratch, df).collect()}
    have = np.array([got[n] for n in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()


def test_forest_of_labels_above_a_task(spark, scratch):
    """Blocks of few vectors: Spark splits the labels first, and deals dense nodes in pairs of parts."""
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = np.zeros(len(rows), int)
    for i, j in brute_links(rows):
        want[i] += 1
        want[j] += 1
    for cells in (64 * 16, 20 * 16):
        by = {x.vec_id: x for x in op4_forest.near_duplicates(scratch, df, leaf=16, cells=cells).collect()}
        have = np.array([by[r[0]].n_links for r in rows])
        assert (have <= want).all() and have.sum() >= 0.95 * want.sum()


def brute_groups(texts, similarity=0.8):
    sets = [set(op10_simhash.shingles(t, 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]))]
    return union(len(texts), links), links


def test_representatives_of_near_copies(spark, scratch):
    """Copies with a few words changed: nearly all at a Jaccard similarity of 0.8 or more go, and none below."""
    r = random.Random(12)
    texts = []
    for n in range(120):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(40, 400))]
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for _ in range(r.randrange(1 + len(words) // 40)):
                other[r.randrange(len(other))] = "changed"
            texts.append(" ".join(other) if r.random() < 0.9 else " ".join(other).upper())
    texts += ["", None, " \n", "one two", "ONE two", "one two three"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(None, texts[0]), (7, "another text under the same id here"), (7, texts[7])], "doc_id long, text string")
    kept = {(x.doc_id, x.rows) for x in op10_simhash.representatives(scratch, docs).collect()}
    root, _ = brute_groups(texts)
    first = {n for n in range(len(texts)) if root[n] == n}
    assert first <= {n for n, _ in kept}  # the smallest of a group always stays
    dropped = len(texts) - len(first)
    assert len({n for n, _ in kept} - first - {7}) <= 0.05 * dropped
    assert op10_simhash.representatives(scratch, docs.limit(0)).count() == 0


def test_representatives_in_small_tries(spark, scratch):
    """One dense group, in tries cut into parts of few: the same groups as in large ones."""
    r = random.Random(13)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for n in range(150):
        other = list(words)
        other[r.randrange(200)] = f"x{n}"
        rows.append((n, " ".join(other)))
    sk = op10_simhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = sk.selectExpr("fp", "doc_id as cls")
    for most in (16, 1024):
        found = {x.node: x.component for x in connected_components(scratch, op10_simhash.similar_pairs(scratch, classes, most=most)).collect()}
        assert len(found) == 150 and set(found.values()) == {0}


def near_threshold():
    """Pairs on either side of 0.8, chains of them, one dense group around it, and a text that is nearly all repeats."""
    r = random.Random(21)
    texts = []
    for n in range(250):
        words = [f"w{r.randrange(9000)}" for _ in range(r.randrange(6, 90))]
        texts.append(" ".join(words))
        for _ in range(2):  # about a ninth of the shingles, on either side of the text
            words = list(words)
            for at in range(r.randrange(1, 2 + len(words) // 45)):
                words[r.randrange(len(words))] = f"y{n}-{at}"
            if r.random() < 0.3:
                words += [f"z{r.randrange(9000)}" for _ in range(r.randrange(1 + len(words) // 5))]
            texts.append(" ".join(words))
    words = [f"v{n}" for n in range(44)]
    for n in range(150):
        other = list(words)
        other[r.randrange(44)] = f"x{n}"
        texts.append(" ".join(other))
    words = [f"u{n}" for n in range(1500)]  # long texts, of which more shared shingles are asked for
    for n in (0, 20, 25, 29, 30, 31, 32, 33, 34, 40):
        other = list(words)
        for k in range(n):
            other[r.randrange(1500)] = f"q{n}-{k}"
        texts.append(" ".join(other))
    line = "the same seven words in every line "
    return [*texts, line * 200, line * 200 + " ".join(f"t{n}" for n in range(40))]


def test_representatives_lose_no_link_and_add_none(spark, scratch):
    texts = near_threshold()
    root, links = brute_groups(texts)
    assert 300 < len(links) and root[-1] == len(texts) - 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in op10_simhash.representatives(scratch, docs).collect()} == set(root)


def test_open_pairs_hold_every_link(spark, scratch):
    """Without groups, in blocks cut into parts of few and in whole ones, with and without common shingles: no link is missing."""
    texts = near_threshold()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, links = brute_groups(texts)
    sets = [frozenset(op10_simhash.shingles(t, 5).tolist()) for t in texts]
    want = {(j, i) for i, j in links if sets[i] != sets[j]}
    none = spark.createDataFrame([], "node long, component long")
    for common, most in ((op10_simhash.NONE, 16), (op10_simhash.common_shingles(docs), 1024)):
        classes = scratch.table(op10_simhash.sketches(docs, common=common).withColumnRenamed("doc_id", "cls"), "classes")
        assert want <= {tuple(x) for x in op10_simhash.open_pairs(scratch, classes, none, most=most).collect()}
    one = classes.selectExpr("cls as node", "0L as component")
    assert op10_simhash.open_pairs(scratch, classes, one).count() == 0


def test_open_links_of_cut_clusters_join_what_links_join(spark, scratch):
    """Shared shingles and clusters in one block or cut into parts of few: links only, and with them the same groups as by brute force."""
    texts = near_threshold()
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    root, links = brute_groups(texts)
    classes = op10_simhash.sketches(docs).selectExpr("doc_id as cls", "struct(doc_id, tie) as own", "size", "wide", "odd", "rare")
    classes = scratch.table(classes, "classes")
    none = spark.createDataFrame([], "node long, component long")
    for most, load in ((16, 2000), (1024, 1 << 22)):
        found = {tuple(x) for x in op10_simhash.open_links(scratch, docs, classes, none, most=most, load=load).collect()}
        assert found <= {(j, i) for i, j in links}
        assert union(len(texts), found) == root
    one = classes.selectExpr("cls as node", "0L as component")
    assert op10_simhash.open_links(scratch, docs, classes, one).count() == 0


def test_rows_of_a_dense_cluster_do_not_grow_with_its_square(spark, scratch, monkeypatch):
    """300 near copies that no fingerprint has joined: spanning links come back, not their 44,850 pairs."""
    r = random.Random(31)
    words = [f"w{n}" for n in range(200)]
    rows = []
    for n in range(300):
        other = list(words)
        other[r.randrange(200)] = f"x{n}"
        rows.append((n, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, real = [], op10_simhash.connected_components

    def counted(scratch, edges):
        made.append(edges.count())
        return real(scratch, edges)

    monkeypatch.setattr(op10_simhash, "connected_components", counted)
    monkeypatch.setattr(op10_simhash, "similar_pairs", lambda *_: spark.createDataFrame([], "a long, b long"))
    assert [tuple(x) for x in op10_simhash.representatives(scratch, docs).select("doc_id", "rows").collect()] == [(0, 1)]
    assert made[-1] < 300 and max(made) < 300 * 45  # a class has 41 rarest shingles


def test_forest_of_empty_table(spark, scratch):
    assert op4_forest.near_duplicates(scratch, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
