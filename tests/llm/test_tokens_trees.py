"""SentencePiece offsets, Merkle manifest and token alignment against the libraries and brute force."""

import functools
import hashlib
import itertools
import random
import resource
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as files
from tokenizers import Tokenizer

from lexplane.llm import op9_bpe, op11_sentencepiece, op12_merkle, op13_alignment
from lexplane.llm.common import Scratch

BYTES, PIECES = op9_bpe.default_vocab(), op11_sentencepiece.default_model()
PARTS = [" ", "  ", "\n", "\n  ", "a", "the", "The", ";\r", "\r", "\t", "　", "▁", "é", "日本", "🎉", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "\x00", "\x1c", "xxxxx", "\xa0", "don't", "'s", "Über", ".", "1234", "\x85", " "]


def texts(n, seed, without=""):
    r = random.Random(seed)
    return ["".join(r.choice([p for p in PARTS if p not in without or not without]) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def spans(lib, text):
    pieces = lib.encode(text, return_type="proto").pieces
    return [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]


def same(x):
    return sorted(tuple(map(str, r)) for r in x)


def test_pieces_and_spans():
    own, lib = op11_sentencepiece.SentencePieces(PIECES, remembered=200), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert own.cuts.startswith(" \n")
    for t in ["", " ", "  ", "▁", "a" * 3000, "日" * 400, *texts(800, 1)]:
        assert own.encode(t) == spans(lib, t), t
        ids = lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)
        assert list(own.digest_all([t]))[0][2:] == (hashlib.sha256(lib.decode(ids).encode()).hexdigest(), len(t.encode()))
    r = random.Random(5)
    for _ in range(300):  # any ids, bytes that are no text among them
        ids = [r.choice([r.randrange(3, 259), r.randrange(32000)]) for _ in range(6)]
        assert own.decode(ids) == lib.decode(ids), ids


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map(tmp_path, rule, squeeze):
    """A compiled map of the library in the given model: longest prefixes, source alignment, white space taken out."""
    model, other = files.ModelProto(), files.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = model.normalizer_spec
    spec.precompiled_charsmap, spec.remove_extra_whitespaces = other.normalizer_spec.precompiled_charsmap, squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    own, lib = op11_sentencepiece.SentencePieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert own.cuts == ""
    for t in ["Ａ①ﬁ  x ", "  ", "ｶﾞ ㌔", "é", *texts(300, 2)]:
        assert own.encode(t) == spans(lib, t), t
        assert own.decode(own.encode(t)[0]) == lib.decode(lib.encode(t))


def test_encode_documents(spark, docs, rows, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = op11_sentencepiece.encode(docs, PIECES, ["doc_id", "source"]).collect()
    want = [(r[0], r[3], *spans(lib, r[1] or ""), lib.decode(lib.encode(r[1] or ""))) for r in rows]
    assert same(got) == same(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r[0], len(i := lib.encode(r[1] or "")), sha(",".join(map(str, i))), sha(lib.decode(i)), len((r[1] or "").encode())) for r in rows]
    assert same(op11_sentencepiece.digests(docs, PIECES).collect()) == same(want)
    assert op11_sentencepiece.digests(empty, PIECES).collect() == []


def test_encoders_forget():
    """A worker's memory stays bounded: millions of distinct words leave no more than the remembered ones behind."""
    bpe = op9_bpe.Speculator(*BYTES, remembered=20_000)
    own = op11_sentencepiece.SentencePieces(PIECES, remembered=20_000)
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    peak = []
    for n in range(60):
        batch = [" ".join(word() for _ in range(2000)) for _ in range(5)]
        bpe.ids_of_texts(batch)
        own.slots(batch)
        assert len(bpe.seen) <= 4 * bpe.remembered + 60_000 and len(own.memo.slot) <= own.memo.remembered + 10_000
        peak.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
    assert peak[-1] - peak[20] < 60_000  # kilobytes, while 400,000 more words passed


def test_worker_drops_its_encoder(spark, docs):
    op9_bpe.speculator.cache_clear()
    list(op9_bpe.dropped(lambda batches: (op9_bpe.speculator(*BYTES, 100) for _ in batches))([1]))
    assert op9_bpe.speculator.cache_info().currsize == 0


H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(rows):
    by = defaultdict(list)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    for i, s, lang, n, t in rows:
        by[s].append((i, H(*map(field, (i, s, lang, n, t))), lang, n, t))

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for place, (i, leaf, lang, n, t) in enumerate(by[s]):
            path = []
            for tree, q in ((trees[s], place), (top, k)):
                for row in tree[:-1]:
                    path.append((q % 16, row[q // 16 * 16 : q // 16 * 16 + 16]))
                    q //= 16
            d = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
                d = H(*map(field, (i, s, lang, n, t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t))))
            for j, run in path:
                d = H(*run[:j], d, *run[j + 1 :])
            out.append((i, leaf, trees[s][-1][0], top[-1][0], H(*[x for j, run in path for m, x in enumerate(run) if m != j]), d, d == top[-1][0]))
    return out


def proofs(scratch, docs):
    return same(op12_merkle.prove(*op12_merkle.manifest(scratch, op12_merkle.document_leaves(docs))).collect())


def test_manifest(spark, docs, rows, empty, scratch):
    assert proofs(scratch, docs) == same(brute_tree([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))
    assert proofs(scratch, empty) == [] and len(proofs(scratch, docs.limit(1))) == 1


def test_manifest_of_deep_trees(spark, scratch):
    """One source with most rows over several storeys and runs, many sources with a row each, repeated rows, null ids."""
    rows = [(n, "big" if n % 3 else f"s{n}" if n % 500 else None, None, n, f"T{n}") for n in range(9000)] + [(None, "big", "x", None, None)] * 3 + [(7, "big", "x", None, "Q")] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert proofs(scratch, df) == same(brute_tree([(r[0], r[1], r[2], r[3], r[4]) for r in rows]))


def test_levels_are_stored(spark, docs, rows, scratch):
    trees, _ = op12_merkle.manifest(scratch, op12_merkle.document_leaves(docs))
    sizes = Counter(r[3] for r in rows)
    assert {r.n for r in trees.level(0).select("n").distinct().collect()} == set(sizes.values())
    assert trees.roots().count() == len(sizes)


@functools.cache
def bytes_of_pieces():
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [bytes([int(own.id_to_piece(n)[3:5], 16)]) if own.is_byte(n) else own.id_to_piece(n).replace("▁", " ").encode() for n in range(own.get_piece_size())]


def brute_alignment(rows):
    a_of, b_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(op9_bpe._byte_letters())}
    piece = bytes_of_pieces()
    found, counts = [], Counter()
    for i, t in rows:
        a, b, whole = a_of.encode(" " + (t or ""), add_special_tokens=False), b_of.encode(t or ""), (" " + (t or "")).encode()
        parts_a, parts_b = [bytes(byte[c] for c in x) for x in a.tokens], [piece[x] for x in b]
        if not t or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            found.append((i, 0, 0, [], []))
            continue
        ends = dict(zip(itertools.accumulate(map(len, parts_a)), range(len(parts_a)), strict=True))
        links, groups, x0, y0, end = [], [], 0, 0, 0
        for y, part in enumerate(parts_b):
            end += len(part)
            if end in ends:
                x = ends[end]
                links.append((a.ids[x], b[y]))
                groups.append(",".join(map(str, a.ids[x0 : x + 1])) + "|" + ",".join(map(str, b[y0 : y + 1])))
                x0, y0 = x + 1, y + 1
        counts.update(links)
        found.append((i, len(a.ids), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, x, y, len(g), len(p), sum(counts[k] == best[k[1]] for k in p), sum(counts[k] for k in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g)) for i, x, y, g, p in found]


def align(spark, docs, **more):
    return same(op13_alignment.alignments(Scratch(spark, "test"), docs, *BYTES, PIECES, groups=True, **more).collect())


def test_alignment(spark, docs, rows, empty):
    assert align(spark, docs) == same(brute_alignment([(r[0], r[1]) for r in rows]))
    assert align(spark, empty) == []
    assert align(spark, docs.where("text is null")) == same(brute_alignment([(r[0], None) for r in rows if r[1] is None]))


def test_alignment_over_chunks(spark):
    rows = [*enumerate(texts(700, 3, "▁")), *enumerate(texts(60, 4)), (None, ""), (None, "  "), (5, "a" * 3000), *[(9, "same text here")] * 50]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert align(spark, df, chunk_bytes=3000) == same(brute_alignment(rows))
