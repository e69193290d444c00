import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from lexplane.llm import op1_lines, op3_mixing, op5_divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"


def test_boilerplate_lines(scratch, docs, rows):
    totals, seen = Counter(r[3] for r in rows), Counter()
    for r in rows:
        for line in {x.strip(WHITE) for x in (r[1] or "").split("\n")} - {""}:
            seen[r[3], line] += 1
    bad = {k for k, n in seen.items() if n >= 3 and n > 0.1 * totals[k[0]]}
    assert bad
    want = Counter()
    for r in rows:
        ls = [] if r[1] is None else r[1].split("\n")
        kept = [x for x in ls if (r[3], x.strip(WHITE)) not in bad]
        want[r[0], len(ls), len(ls) - len(kept), r[1] if len(kept) == len(ls) else "\n".join(kept), r[5]] += 1
    got = Counter((x.doc_id, x.n_lines, x.n_dropped, x.text, x.size) for x in op1_lines.drop_boilerplate(scratch, docs).collect())
    assert got == want


def test_boilerplate_by_host(spark, scratch):
    """Sites are hosts of URLs: a line is counted over the pages of one host, whatever its case, port or user."""
    urls = ["http://A.example/1", "https://a.example:80/2", "http://u@a.EXAMPLE/3?x", "http://b.example/", None, "no url"]
    rows = [(n, url, f"menu\nbody {n}", 1) for n, url in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, __bad int")
    got = {x.page_id: x for x in op1_lines.drop_boilerplate(scratch, pages, op1_lines.host_of(pages.url), "html").collect()}
    assert [got[n].html for n in range(6)] == ["body 0", "body 1", "body 2", "menu\nbody 3", "menu\nbody 4", "menu\nbody 5"]
    assert got[0]["__bad"] == 1


def test_boilerplate_of_empty_table(scratch, empty):
    assert op1_lines.drop_boilerplate(scratch, empty).count() == 0


def _targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[n % 3] for n, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
        if not open_:
            return out


def test_mix(scratch, docs, rows):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = _targets(sizes)
    got = op3_mixing.decisions(scratch, docs).collect()
    assert Counter((x.doc_id, x.source, x["size"]) for x in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    taken = Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-9)
        assert 0 <= x.copies <= 2
        taken[x.source] += x.copies * x["size"]
    for s in sizes:
        biggest = max(size(r[1]) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= biggest
    again = op3_mixing.decisions(scratch, docs.repartition(7)).collect()
    key = lambda xs: sorted(map(str, xs))
    assert key(got) == key(again)
    mixed = op3_mixing.mix(scratch, docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(x.copies for x in got)


def test_mix_of_empty_table(scratch, empty):
    assert op3_mixing.decisions(scratch, empty).count() == 0


def test_mix_against_brute_force(scratch, docs):
    """Expected copies by bisection, ranks sorted as a whole, and the cut where the words come nearest to the need."""
    from pyspark.sql import functions as F

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(op3_mixing.SEED), "doc_id", "tie"), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = {(x.doc_id, x.text): (x.u, x.tie) for x in docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).withColumn("u", u).collect()}
    got = op3_mixing.decisions(scratch, docs, rows=True).collect()
    by = defaultdict(list)
    for x in got:
        by[x.source].append((x["size"], drawn[x.doc_id, x.row.text], x.doc_id, x.copies, x.target))
    sampled = 0
    for of in by.values():
        target = of[0][4]
        copies = lambda size, f: min(2.0, f * math.sqrt(size))
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(s * copies(s, mid) for s, *_ in of) < target else (low, mid)
        capped = target >= 2 * sum(s for s, *_ in of)
        pool, sure = defaultdict(list), 0
        for s, (draw, tie), i, have, _ in of:
            e = 0.0 if s == 0 else 2.0 if capped else copies(s, high)
            whole = math.floor(e + 1e-9)
            sure += whole * s
            lam = e - whole
            if lam > 1e-9:
                odds = draw / (1 - draw) / (lam / (1 - lam))
                pool[odds, -1 if i is None else i, tie].append((s, whole, have))
            else:
                assert have == whole
        upto = 0
        for _, same in sorted(pool.items()):
            upto += sum(s for s, *_ in same)
            for s, whole, have in same:
                assert have == whole + (upto - s / 2 <= target - sure)
                sampled += 1
    assert sampled > 20


def test_pareto_odds(spark, scratch):
    """Inclusion follows size: of many equal pairs, large documents are taken more often; the words still meet the target."""
    rows = [(n, "w " * (400 if n % 2 else 25), ["a", "b", "c"][n % 3]) for n in range(3000)]
    got = op3_mixing.decisions(scratch, spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 10, 10)).where("source = 'a'").collect()
    large, small = ([x.copies for x in got if x["size"] == s] for s in (400, 25))
    assert sum(large) / len(large) > 2.5 * sum(small) / len(small)
    taken, target = sum(x.copies * x["size"] for x in got), got[0].target
    assert abs(taken - target) <= 400


def brute_counts(text):
    ws = WORD.findall(text)
    wins = defaultdict(list)
    for i in range(len(ws) - 2):
        wins[tuple(ws[i : i + 3])].append(i)
    cover = {j for at in wins.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_base_counts(scratch, docs, rows):
    got = Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in op5_divergence.quality(scratch, docs).collect())
    want = Counter()
    for r in rows:
        c = brute_counts(r[1] or "")
        want[r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert got == want


def test_divergence(spark, scratch, empty):
    from pyspark.sql import functions as F

    p, q = [3, 1, 0, 4], [1, 1, 2, 0]
    got = spark.range(1).select(op5_divergence.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    a, b = [x / 8 for x in p], [x / 4 for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    kl = lambda u: sum(x * math.log2(x / y) for x, y in zip(u, m, strict=True) if x)
    assert got == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert op5_divergence.quality(scratch, empty).count() == 0


def brute_class(c):
    kind = unicodedata.category(c)
    letters = {"Ll": 0, "Lu": 1, "Lt": 2, "Lm": 2, "Lo": 2, "Nd": 3, "Nl": 3, "No": 3}
    return letters[kind] if kind in letters else 4 if c in WHITE else 5 if c in "#*$%&|<>" else 6 if c in ".,;:!?'\"()-" else 7


def brute_distance(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda u: sum(x * math.log2(x / ((y + z) / 2)) for x, y, z in zip(u, p, q, strict=True) if x)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_verdicts_against_brute_force(scratch, docs, rows):
    """Histograms counted character by character and word by word, held against the sums of their language."""
    counted = []
    for r in rows:
        text = r[1] or ""
        chars, words = [0] * 8, [w.lower() for w in WORD.findall(text)]
        for c in text:
            chars[brute_class(c)] += 1
        counted.append((r, chars, [words.count(w) for w in op5_divergence.COMMON.get(r[2], [])]))
    sums = defaultdict(lambda: ([0] * 8, [0] * 24))
    for r, chars, common in counted:
        for total, part in zip(sums[r[2]], (chars, common), strict=True):
            for n, x in enumerate(part):
                total[n] += x
    want = []
    for r, chars, common in counted:
        far = [brute_distance(h, total[: len(h)]) for h, total in zip((chars, common), sums[r[2]], strict=True)]
        c = brute_counts(r[1] or "")
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        odd = bool((sum(chars) >= 400 and far[0] > 0.25) or (sum(common) >= 20 and far[1] > 0.6))
        want.append((str(r[0]), not failed and not odd, *(x is not None and round(x, 6) for x in far)))
    got = [(str(x.doc_id), x.kept, *(y is not None and round(y, 6) for y in (x.js_chars, x.js_words))) for x in op5_divergence.quality(scratch, docs).collect()]
    assert Counter(got) == Counter(want)
    assert any(k for _, k, *_ in want)


def test_junk_is_dropped_and_prose_kept(spark, scratch):
    base = [" ".join(f"{w}{chr(97 + (n * 7 + k) % 26)}" if k % 3 else w for k, w in enumerate(["the", "stone", "of", "river", "and", "green"] * 20)) for n in range(50)]
    rows = [(n, t, "en", "s", 1) for n, t in enumerate(base)] + [(100, base[0].upper(), "en", "s", 1), (101, " ".join(w + "***" for w in base[1].split()), "en", "s", 1)]
    got = {x.doc_id: x for x in op5_divergence.quality(scratch, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).collect()}
    assert not got[100].kept and not got[101].kept
    assert all(got[n].js_chars < 0.25 for n in range(50))
