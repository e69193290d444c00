"""Alignment of two tokenizers' tokens over a corpus, worked out once for each distinct segment of text.

Texts are cut before runs of white space that neither vocabulary can merge across (segments.cut_characters checks both),
so that at each cut both encodings have a token's end. One pass over the documents writes them as codes into small
dictionaries, one for each chunk of some megabytes; the distinct segments of all dictionaries are tokenised and aligned
once; the counts of linked ids over the corpus follow from the segments' counts; and each chunk's documents are put
together from its dictionary's alignments. Texts are not shuffled, and a segment moves once a chunk, not once a place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, in_batches
from .op9_bpe import Speculator
from .op11_sentencepiece import SPACE, SentencePieces
from .segments import cut_characters, cutter

CODED = "chunk long, doc_id long, codes binary, place long, seg string, n long"
ALIGNED = "id long, seg string, n long, groups string, links array<long>"
#: A link is a pair of ids as one number, a * PAIR + b.
PAIR = 1 << 32
#: A place in a dictionary is a chunk and an index as one number; so many bits each for the index, and for a task's chunks.
INDEX, CHUNKS = 25, 14


class Aligner:
    """Both encoders, and the alignment of segments. Strings of special tokens are plain text."""

    def __init__(self, byte_vocab: str, pattern: str, piece_model: str):
        self.a, self.b = Speculator(byte_vocab, pattern, 50_000), SentencePieces(piece_model)
        if not self.b.cuts:
            raise ValueError("texts cannot be cut for this piece model")
        self.width_a, self.width_b = ([len(x) for x in e.bytes_of] for e in (self.a, self.b))
        self.digits = [str(n) for n in range(max(len(self.width_a), len(self.width_b)))]

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        words = [self.a.words.findall(s) for s in segments]
        distinct = list(dict.fromkeys(chain.from_iterable(words)))
        ids = dict(zip(distinct, self.a.encode_words([w.encode("utf-8") for w in distinct]), strict=True))
        flat, _, counts = self.b.encode_segments(segments)
        found, ends = flat.tolist(), np.cumsum(counts).tolist()
        return [[t for w in ws for t in ids[w]] for ws in words], [found[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def align(self, segments: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Of each segment: the groups in print, and the linked ids."""
        width_a, width_b, digits = self.width_a, self.width_b, self.digits
        for a, b in zip(*self.tokens(segments), strict=True):
            groups, links = [], []
            i = j = x = 0
            end_a = width_a[a[0]]
            end_b = 0
            for y, t in enumerate(b):
                end_b += width_b[t]
                while end_a < end_b:
                    x += 1
                    end_a += width_a[a[x]]
                if end_a == end_b:
                    groups.append(",".join([digits[k] for k in a[i : x + 1]]) + "|" + ",".join([digits[k] for k in b[j : y + 1]]))
                    links.append(a[x] * PAIR + t)
                    i, j = x + 1, y + 1
            yield ";".join(groups), links


def cuts_of(byte_vocab: str, pattern: str, piece_model: str) -> str:
    """The characters before whose runs both vocabularies allow a cut."""
    both = Aligner(byte_vocab, pattern, piece_model)
    found = cut_characters(both.a.vocab, (both.b.bytes_of[n] for n in both.b.id_of.values()))
    if " " not in found:
        raise ValueError("texts cannot be cut for these vocabularies")
    return found


def _packed(codes: np.ndarray) -> bytes:
    return codes.nbytes.to_bytes(8, "little") + pa.compress(codes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.int32)


def coded(docs: DataFrame, cuts: str, chunk_bytes: int = 32 << 20) -> DataFrame:
    """CODED: a row for each document (doc_id, codes) and one for each entry of a chunk's dictionary (place, seg, n).

    codes: indices as 32-bit integers, compressed by zstd, with their number of bytes in front.

    A chunk ends with the batch that takes it beyond chunk_bytes of text, so that it holds no more than that and a
    batch, or one text. Null and empty texts, and those with U+2581, whose pieces spell a space, have no codes.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("place", pa.int64()), ("seg", pa.string()), ("n", pa.int64())])

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(cuts)
        number = first = TaskContext.get().partitionId() << CHUNKS
        known: dict[str, int] = {}
        counts, taken = np.zeros(0, np.int64), 0

        def dictionary() -> Iterator[pa.RecordBatch]:
            segments, k = list(known), len(known)
            for at in range(0, k, 20_000):
                part = segments[at : at + 20_000]
                places = (number << INDEX) + np.arange(at, at + len(part))
                yield rows(len(part), place=pa.array(places), seg=pa.array(part, pa.string()), n=pa.array(counts[at : at + len(part)]))

        for b in batches:
            found = [cut(" " + t) if t and SPACE not in t else [] for t in b.column(1).to_pylist()]
            for segments in found:
                for s in segments:
                    if s not in known:
                        known[s] = len(known)
            get = known.__getitem__
            flat = np.fromiter(map(get, chain.from_iterable(found)), np.int32)
            counts = np.bincount(flat, minlength=len(known)) + np.pad(counts, (0, len(known) - len(counts)))
            codes = [_packed(x) for x in np.split(flat, np.cumsum([len(x) for x in found])[:-1])]
            yield rows(len(found), chunk=pa.array(np.full(len(found), number)), doc_id=b.column(0), codes=pa.array(codes, pa.binary()))
            taken += b.column(1).nbytes
            if taken > chunk_bytes:
                yield from dictionary()
                known, counts, taken, number = {}, np.zeros(0, np.int64), 0, number + 1
                if number - first == 1 << CHUNKS:
                    raise ValueError("a task has too many chunks: raise chunk_bytes, or read smaller partitions")
        yield from dictionary()

    return src.mapInArrow(in_batches(run, 4096, text=1), CODED)


def aligned(segments: DataFrame, byte_vocab: str, pattern: str, piece_model: str) -> DataFrame:
    """ALIGNED of distinct segments (id, seg, n)."""
    schema = pa.schema([("id", pa.int64()), ("seg", pa.string()), ("n", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Aligner | None = None
        for b in batches:
            own = own or Aligner(byte_vocab, pattern, piece_model)
            groups, links = zip(*own.align(b.column(1).to_pylist()), strict=True)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in links]))).astype(np.int32)
            pairs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(links), np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(groups, pa.string()), pairs], schema=schema)

    return segments.select("id", "seg", "n").mapInArrow(in_batches(run, 8192, text=1), ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best) of ALIGNED: how many links of the corpus hold the pair, and whether no pair of its b has more."""
    pairs = found.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % PAIR)
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _compose(groups: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(docs: pa.Table, entries: pa.Table) -> pa.Table:
        packed = entries.column("packed").to_numpy()  # index and number of best links
        at, n_best = packed >> 32, packed & PAIR - 1
        printed: list[bytes] = [b""] * len(at)
        table = np.zeros((len(at), len(names)), np.int64)
        for n, g in zip(at.tolist(), entries.column("groups").to_pylist(), strict=True):
            printed[n] = g.encode()
            sides = g.replace("|", ";").split(";")
            table[n, 0] = sum(x.count(",") + 1 for x in sides[::2])
            table[n, 1] = sum(x.count(",") + 1 for x in sides[1::2])
            table[n, 2] = table[n, 3] = len(sides) // 2
        table[at, 4], table[at, 5] = n_best, entries.column("count_sum").to_numpy()
        sums, digests, texts = [], [], []
        for codes in docs.column("codes"):
            codes = _unpacked(codes.as_py())
            sums.append(table[codes].sum(0))
            text = b";".join(map(printed.__getitem__, codes.tolist()))
            digests.append(hashlib.sha256(text).hexdigest() if len(codes) else "")
            if groups:
                texts.append(text.decode())
        sums = np.array(sums, np.int64).reshape(-1, len(names))
        columns = {"doc_id": docs.column("doc_id"), **{n: pa.array(sums[:, k]) for k, n in enumerate(names)}, "groups_sha256": pa.array(digests, pa.string())}
        return pa.table({**columns, "groups": pa.array(texts, pa.string())} if groups else columns)

    return run


def alignments(scratch: Scratch, docs: DataFrame, byte_vocab: str, pattern: str, piece_model: str, groups: bool = False, chunk_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; groups: the groups in print too.

    A null, empty or U+2581-holding text has zeros and empty strings. Repeated rows count as often as they stand; a
    null doc_id stays null; of equal counts of a piece all are best; extra columns are not read. A segment is of any
    length; one that has no white space is tokenised whole, in time n log n.
    """
    both = (byte_vocab, pattern, piece_model)
    table = scratch.table(coded(docs, cuts_of(*both), chunk_bytes), "coded")
    entries, rows = table.where("seg is not null").select("place", "seg", "n"), table.where("seg is null").select("chunk", "doc_id", "codes")
    segments = scratch.table(entries.groupBy("seg").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("id"), "seg", "n"), "segments")
    found = scratch.table(aligned(segments, *both), "aligned")
    scratch.drop(segments)
    pairs = scratch.table(pair_counts(found), "pairs")
    links = found.select("id", F.explode("links").alias("pair")).join(broadcast_if_small(pairs, 300_000), "pair")
    sums = links.groupBy("id").agg(F.sum("count").alias("count_sum"), F.count_if("best").cast("int").alias("n_best"))
    whole = scratch.table(found.join(sums, "id").select("seg", "n_best", "count_sum", "groups"), "whole")
    for used in (found, pairs):
        scratch.drop(used)
    index = F.col("place").bitwiseAND((1 << INDEX) - 1)
    parts = entries.select("place", "seg").join(whole, "seg").select(F.shiftright("place", INDEX).alias("part"), (F.shiftleft(index, 32) + F.col("n_best")).alias("packed"), "count_sum", "groups")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if groups else "")
    return rows.groupBy("chunk").cogroup(parts.groupBy("part")).applyInArrow(_compose(groups), schema)
