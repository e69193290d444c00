"""Byte-level BPE encoding by speculation: propose greedily, verify every adjacent pair at once, merge only what fails.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are the encoding of theirs, and
two tokens are so unless, while both are being built, some pair at their border is merged before either part of it is
used up. A token's parts at its border form a spine (its last part, that part's last part, ...), so a pair of tokens
is checked by looking up all pairs of two short spines in the table of merges, for all pairs of a batch in step.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_batches
from .merging import NEVER, PairTable
from .pieces import BYTE_LEVEL, Memo



class Speculator(Memo):
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str, remembered: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space are not supported")
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        vocab = {bytes(byte_of[c] for c in t): n for t, n in model["vocab"].items() if all(c in byte_of for c in t)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        self.vocab = vocab
        self.reach: dict[bytes, int] = {}  # by the first four bytes, the longest token's length
        for t in vocab:
            if len(t) > 3:
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 0))
        self.words = regex.compile(pattern)
        top = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for t, n in vocab.items():
            self.bytes_of[n] = t
        for t, n in self.added.items():
            self.bytes_of[n] = t.encode()
        self.digits = [str(n) for n in range(top)]
        self.size = top
        rank: dict[int, int] = {}
        merged: dict[int, int] = {}
        left, right, born = np.full(top, -1), np.full(top, -1), np.full(top, -1)
        ids = {t: n for t, n in model["vocab"].items()}
        self.checkable = True
        for n, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            rank[x * top + y], merged[x * top + y] = n, z
            self.checkable &= born[z] < 0 and max(born[x], born[y]) < n
            left[z], right[z], born[z] = x, y, n
        ends, made = (np.array(list(x.values()), np.int64) for x in (rank, merged))
        codes = np.array(list(rank), np.int64)
        self.table = PairTable(codes // top, codes % top, ends, made, top)
        self.byte_ids = np.array([vocab.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.left, self.right, self.born = left, right, born
        self.forget_fits()
        self.proposed = self.failed = 0
        super().__init__(self.added, pattern == BYTE_LEVEL, remembered)

    def age(self) -> None:
        super().age()
        self.printed: list[bytes] = []  # of each slot the decimal ids and the decoded bytes
        self.decoded: list[bytes] = []

    def propose(self, word: bytes) -> list[int]:
        out, at, n, vocab, reach = [], 0, len(word), self.vocab, self.reach
        while at < n:
            end = min(n, at + reach.get(word[at : at + 4], 3))
            while (t := vocab.get(word[at:end])) is None:
                end -= 1
                if end == at:
                    raise ValueError(f"byte {word[at]} is not in the vocabulary")
            out.append(t)
            at = end
        return out

    def pairs_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of tokens whether it is the encoding of its bytes."""
        fit = np.ones(len(a), bool)
        x, used_x = a.copy(), np.full(len(a), NEVER)
        while True:
            on = np.flatnonzero(fit & (x >= 0))
            if not len(on):
                return fit
            y, used_y = b.copy(), np.full(len(b), NEVER)
            while len(on):
                when = self.table.rank_of(x[on], y[on])
                fit[on[(when < used_x[on]) & (when <= used_y[on]) & (when < NEVER)]] = False
                used_y[on], y[on] = self.born[y[on]], self.left[y[on]]
                on = on[fit[on] & (y[on] >= 0)]
            went = np.flatnonzero(x >= 0)
            used_x[went], x[went] = self.born[x[went]], self.right[x[went]]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The exact merging of all words."""
        return self.table.merge([self.byte_ids[np.frombuffer(w, np.uint8)] for w in words])

    def known_fits(self, codes: np.ndarray) -> np.ndarray:
        """Of each code of a pair, ascending and distinct, whether the pair fits; verdicts are kept, at most 4 times `remembered`."""
        at = np.minimum(np.searchsorted(self.seen, codes), len(self.seen) - 1)
        new = codes[self.seen[at] != codes]
        if len(new):
            if len(self.seen) + len(new) > 4 * self.remembered:
                self.forget_fits()
                new = codes
            where = np.searchsorted(self.seen, new)
            fits = self.pairs_fit(new // self.size, new % self.size)
            self.seen, self.fits = np.insert(self.seen, where, new), np.insert(self.fits, where, fits)
        return self.fits[np.searchsorted(self.seen, codes)]

    def forget_fits(self) -> None:
        self.seen, self.fits = np.full(1, -1, np.int64), np.zeros(1, bool)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculate on all words, verify all their pairs in step, and merge those that fail."""
        found = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for x in found for t in x), np.int64, int(counts.sum()))
        bad = np.zeros(len(found), bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(found)), counts)
            inner = owner[1:] == owner[:-1]
            a, b, owner = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
            codes, which = np.unique(a * self.size + b, return_inverse=True)
            fit = self.known_fits(codes)
            bad[owner[~fit[which]]] = True
        if not self.checkable:
            bad[:] = True
        self.proposed += len(words)
        again = np.flatnonzero(bad).tolist()
        for n, ids in zip(again, self.merge([words[n] for n in again]), strict=True):
            found[n] = ids
        self.failed += len(again)
        return found

    def ids_of(self, strings: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        cut: list[list] = []
        for p in strings:
            if spaced:
                cut.append(self.words.findall(p if p[0] == "\n" else " " + p))
            elif self.split_added is not None and any(t in p for t in self.added):
                cut.append([w for n, s in enumerate(self.split_added.split(p)) if s for w in ([self.added[s]] if n % 2 else self.words.findall(s))])
            else:
                cut.append(self.words.findall(p))
        words = list({w for ws in cut for w in ws if isinstance(w, str)})
        ids = dict(zip(words, self.encode_words([w.encode("utf-8") for w in words]), strict=True))
        found = [ids[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else [t for w in ws for t in ([w] if isinstance(w, int) else ids[w])] for ws in cut]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.ids_of_texts(texts)]

    def digest_all(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: the number of its ids, the SHA-256 of the ids in decimal, and that of the text decoded from them."""
        found = self.slots(texts)
        for n in range(len(self.printed), self.n):
            ids = self.ids[self.start[n] : self.start[n] + self.count[n]].tolist()
            self.printed.append(",".join([self.digits[t] for t in ids]).encode())
            self.decoded.append(b"".join([self.bytes_of[t] for t in ids]))
        for slots in found:
            some = slots if not len(slots) or self.count[slots[0]] else slots[1:]  # only a text's first piece can be empty
            each = some.tolist()
            decoded = b"".join(map(self.decoded.__getitem__, each)).decode("utf-8", "replace")
            yield int(self.count[some].sum()), hashlib.sha256(b",".join(map(self.printed.__getitem__, each))).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, more = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else more))
        more += b not in plain
    return letters


@functools.cache
def speculator(path: str, pattern: str, remembered: int = 250_000) -> Speculator:
    """One encoder for each worker process and file. Tasks drop it when they end, so that a reused worker holds none."""
    made = Speculator(path, pattern, remembered)
    give_back()  # what the file's own lists took
    return made


def dropped(f: Callable) -> Callable:
    """f over an iterator, with the process's encoders dropped when it ends, fails or is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            speculator.cache_clear()

    return run


def encode_decode(docs: DataFrame, vocab_path: str, pattern: str, keep: list[str] | None = None, rows: int = 4096) -> DataFrame:
    """The columns in keep, with ids array<int> and decoded string; a null text counts as empty."""
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = speculator(vocab_path, pattern)
        for b in batches:
            ids = bpe.encode_all(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=[*b.schema.names[:-1], "ids", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(in_batches(dropped(run), rows, text=len(keep)), f"{schema}{', ' if schema else ''}ids array<int>, decoded string")


def digests(docs: DataFrame, vocab_path: str, pattern: str, rows: int = 4096, remembered: int = 250_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs.

    What encode_decode() returns, reduced in the same pass so that ids and texts need not leave the worker. A null
    text counts as empty; a null doc_id stays null; extra columns are not read.
    remembered: pieces kept in memory; results do not depend on it.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = speculator(vocab_path, pattern, remembered)
        for b in batches:
            n, ids, texts = zip(*bpe.digest_all(b.column(1).to_pylist()), strict=True)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], schema=schema)

    return src.mapInArrow(in_batches(dropped(run), rows, text=1), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocab() -> tuple[str, str]:
    """Path and pattern of the installed vocabulary."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN
