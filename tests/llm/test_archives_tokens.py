import hashlib
import io
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexplane.llm import op2_warc, op6_sstable, op9_bpe

PATH, PATTERN = op9_bpe.default_vocab()


def test_archives(spark, scratch):
    long = "é" * 100
    rows = [(5, "http://a b/\n", long, 1), (3, "u", long, 2), (9, None, long, 3), (1, "u", None, 4), (2, "u", "", 5), (4, "u", "short", 6), (6, "u", "short", 7), (7, "u", "z\r\n\r\nContent-Length: 3\r\n" * 99, 8), (None, "u", long, 9), (8, "u", "q" * 3_000_000, 10), (8, "u", "q" * 3_000_000, 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archives = op2_warc.write_monolithic(scratch, op2_warc.revisits(scratch, pages), file_bytes=2000)
    got = op2_warc.read_archives(op2_warc.normalise(scratch, archives)).collect()
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        same = [x[0] for x in rows if (x[2] or "") == (h or "") and x[0] is not None]
        ref = min(same) if len(data) >= 100 and i is not None and min(same) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if ref is None else "revisit", ref))
    key = lambda x: str(tuple(x)[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert spark.createDataFrame([], pages.schema).transform(lambda p: op2_warc.read_archives(op2_warc.normalise(scratch, op2_warc.write_monolithic(scratch, op2_warc.revisits(scratch, p))))).count() == 0


def test_archives_of_others(spark, scratch, tmp_path):
    """warcinfo, request and metadata records, uuid ids, field names in any case, folded lines, a blank payload."""
    def rec(kind, rid, payload, length="Content-length"):
        return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-RECORD-ID: {rid}\r\nX-Note: a\r\n  b: c\r\n{length}:{len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    parts = [rec("warcinfo", "<urn:uuid:1>", b"software: x\r\n"), rec("request", "<urn:uuid:2>", b""), rec("response", "<urn:uuid:3>", b"HTTP/1.1 200 OK\r\n\r\nContent-Length: 9\r\n", "CONTENT-LENGTH"), rec("metadata", "<urn:uuid:4>", "é".encode() * 5000)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.warc.gz").write_bytes(z.compress(b"".join(parts)) + z.flush())
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    done = op2_warc.normalise(scratch, archives)
    got = sorted(op2_warc.read_archives(done).collect(), key=lambda x: x.offset)
    assert [(x.record_type, x.payload_bytes, x.page_id) for x in got] == [("warcinfo", 13, None), ("request", 0, None), ("response", 38, None), ("metadata", 10000, None)]
    assert got[3].payload_digest == hashlib.sha256("é".encode() * 5000).hexdigest()


def test_records_of_one_or_many_members():
    parts = [op2_warc.record("response", "u", str(n), "d", "x", b"p" * n * 1000, n * 1000, None) for n in range(40)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = whole.compress(b"".join(parts)) + whole.flush()
    many = b""
    for p in parts:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        many += z.compress(p) + z.flush()
    for data in (one, many):
        for chunk in (17, 1 << 20):
            assert list(op2_warc.split_records(io.BytesIO(data), chunk)) == parts


def test_shards_against_the_library(scratch, docs, rows):
    lib = Tokenizer.from_file(PATH)
    got = op6_sstable.read_shards(op6_sstable.write_shards(scratch, docs, PATH, shard_bytes=20_000)).collect()
    assert [x.doc_id for x in sorted(got, key=lambda x: x.start)] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    want = sorted((str(r[0]), len(ids := [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows)
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == want
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens


def test_shards_of_empty_table(scratch, empty):
    assert op6_sstable.read_shards(op6_sstable.write_shards(scratch, empty, PATH)).count() == 0


def test_lookup():
    r = random.Random(1)
    keys = sorted(r.choices(range(-5000, 5000), k=3000))
    out = io.BytesIO()
    w = op6_sstable.Writer(out, block_bytes=700)
    w.add(op6_sstable.key_of(None), np.array([7]))
    for n, k in enumerate(keys):
        w.add(op6_sstable.key_of(k), np.array([n, k & 0xFFFF]))
    w.finish()
    reader = op6_sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [op6_sstable.id_of(k) for k, _ in reader.scan()] == [None, *keys]
    for k in range(-5010, 5010):
        assert [int(v[0]) for v in reader.lookup(op6_sstable.key_of(k))] == [n for n, x in enumerate(keys) if x == k]
    assert len(reader.lookup(op6_sstable.key_of(None))) == 1
    absent = sum(bool(reader.bloom[op6_sstable._probes(np.array([hash(("a", k)) & (2**64 - 1)], np.uint64), reader.bits)].all()) for k in range(3000))
    assert absent < 120


def test_encoding_against_the_library(docs, rows):
    lib = Tokenizer.from_file(PATH)
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(x[0]), *x[1:]) for x in op9_bpe.digests(docs, PATH, PATTERN).collect()) == sorted(want)
    real = op9_bpe.encode_decode(docs, PATH, PATTERN, keep=["doc_id", "rank"])
    assert real.columns == ["doc_id", "rank", "ids", "decoded"]
    assert real.where(F.col("doc_id") == 61).first().decoded == rows[61][1]


def test_random_texts_against_the_library():
    lib, r = Tokenizer.from_file(PATH), random.Random(2)
    letters = "abehinorst" * 6 + "ABC  \n\t  \x1c'.!-*日é½²​\U0001f600"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    bpe, memo = op9_bpe.Speculator(PATH, PATTERN, remembered=500), op6_sstable.LibraryEncoder(PATH, remembered=500)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 100):
        assert bpe.encode_all(texts[at : at + 100]) == want[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode_all(texts[at : at + 100])] == want[at : at + 100]
    assert 0 < bpe.failed < bpe.proposed


def test_long_words_and_line_ends_against_the_library():
    """Runs of letters beyond the heap's bound, signs behind words, and every kind of white space around line ends."""
    lib, r = Tokenizer.from_file(PATH), random.Random(9)
    bpe, memo = op9_bpe.Speculator(PATH, PATTERN, remembered=300), op6_sstable.LibraryEncoder(PATH, remembered=300)
    texts = ["".join(r.choice("abcdehinorst") for _ in range(n)) for n in (255, 256, 257, 3000, 60_000)] + ["aé" * 700, "ab" * 4000]
    texts += ["".join(r.choice(["\n", " ", "\t", "\r", "\x85", "\x1c", "a", "bc", "it's", "!?", "_x", "7", "¿", "'"]) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["\n", "\na", "a\n", "a\n\nb", " \n a", "a <|endoftext|>\nb", "x's", "x'", "x.'s"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 150):
        assert bpe.encode_all(texts[at : at + 150]) == want[at : at + 150]
        assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode_all(texts[at : at + 150])] == want[at : at + 150]


def test_all_tokens_and_pairs():
    """Every token is the encoding of its bytes, and pairs_fit agrees with merging."""
    bpe, r = op9_bpe.Speculator(PATH, PATTERN), random.Random(4)
    some = r.sample(sorted(bpe.vocab.values()), 4000)
    assert bpe.merge([bpe.bytes_of[t] for t in some]) == [[t] for t in some]
    a, b = np.array(some[:2000]), np.array(some[2000:])
    want = [x == [s, t] for x, s, t in zip(bpe.merge([bpe.bytes_of[s] + bpe.bytes_of[t] for s, t in zip(a, b, strict=True)]), a, b, strict=True)]
    assert bpe.pairs_fit(a, b).tolist() == want
