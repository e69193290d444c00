"""Token ids in sorted-string-table shards, looked up by document id.

File: magic; blocks; block index; Bloom filter; footer. A block holds entries in key order, zstd-compressed:
varint(shared key bytes), varint(other key bytes), varint(value bytes), the other key bytes, the value; every
RESTART-th entry shares nothing, and the block ends with the restart offsets. The sparse index has each block's last
key, offset and length. The footer is of fixed size and says where index and filter stand and how many documents and
ids there are. Keys are 9 bytes that sort as the ids do (null first); values are the ids as little-endian uint16, or
uint32 for vocabularies that need it. Equal keys may repeat.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_batches
from .pieces import Memo

MAGIC, RESTART, FOOTER = b"LXSST001", 16, struct.Struct("<QQQQQQI8s")
BITS, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions of each 64-bit hash."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


class Writer:
    """Writes one shard to an open stream; keys come in ascending order."""

    def __init__(self, out, block_bytes: int = 1 << 18, wide: bool = False):
        self.out, self.block_bytes, self.wide = out, block_bytes, wide
        self.zip = zstandard.ZstdCompressor(level=1)
        self.offset, self.index, self.hashes = 0, [], []
        self.docs = self.ids = 0
        self._fresh()
        self._write(MAGIC)

    def _fresh(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        shared = 0
        if self.n % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.n:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<II", len(self.restarts), self.n)
            data = self.zip.compress(raw)
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append((self.last, self.offset, len(data)))
            self._write(data)
            self._fresh()

    def finish(self) -> None:
        self.flush()
        index_at = self.offset
        self._write(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index))
        bloom_at, bits = self.offset, max(64, BITS * len(self.hashes))
        filled = np.zeros(bits, np.uint8)
        if self.hashes:
            filled[_probes(np.array(self.hashes, np.uint64), bits).ravel()] = 1
        self._write(np.packbits(filled).tobytes())
        body = (index_at, len(self.index), bloom_at, bits, self.docs, self.ids)
        self._write(FOOTER.pack(*body, int(self.wide), MAGIC))


class Reader:
    """Random access to one shard: footer, index and filter are read at once, blocks when needed."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        index_at, blocks, bloom_at, self.bits, self.docs, self.ids, wide, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or cut off")
        source.seek(index_at)
        tail = source.read(size - FOOTER.size - index_at)
        self.bloom = np.unpackbits(np.frombuffer(tail, np.uint8, offset=bloom_at - index_at))
        self.type, self.index, at = "<u4" if wide else "<u2", [], 0
        for _ in range(blocks):
            n, at = _read_varint(tail, at)
            key, at = tail[at : at + n], at + n
            offset, at = _read_varint(tail, at)
            length, at = _read_varint(tail, at)
            self.index.append((key, offset, length))
        self.unzip = zstandard.ZstdDecompressor()

    def block(self, n: int) -> tuple[bytes, list[int], int]:
        _, offset, length = self.index[n]
        self.source.seek(offset)
        data = self.source.read(length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {n} is damaged")
        raw = self.unzip.decompress(data[:-4])
        restarts, entries = struct.unpack("<II", raw[-8:])
        return raw, list(struct.unpack_from(f"<{restarts}I", raw, len(raw) - 8 - 4 * restarts)), entries

    @staticmethod
    def _entry(raw: bytes, at: int, last: bytes) -> tuple[bytes, bytes, int]:
        shared, at = _read_varint(raw, at)
        own, at = _read_varint(raw, at)
        length, at = _read_varint(raw, at)
        return last[:shared] + raw[at : at + own], raw[at + own : at + own + length], at + own + length

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.index)):
            raw, _, entries = self.block(n)
            at, key = 0, b""
            for _ in range(entries):
                key, value, at = self._entry(raw, at, key)
                yield key, np.frombuffer(value, self.type).astype(np.uint32)

    def lookup(self, key: bytes) -> list[np.ndarray]:
        """All values of key: filter, binary search of the index, then of the block's restarts, then a short walk."""
        if not self.bloom[_probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), self.bits)].all():
            return []
        out, n = [], bisect_left(self.index, key, key=lambda x: x[0])
        while n < len(self.index):
            raw, restarts, entries = self.block(n)
            first = max(0, bisect_left(restarts, key, key=lambda at: self._entry(raw, at, b"")[0]) - 1)
            at, found, done = restarts[first], b"", first * RESTART
            while done < entries and found <= key:
                found, value, at = self._entry(raw, at, found)
                done += 1
                if found == key:
                    out.append(np.frombuffer(value, self.type).astype(np.uint32))
            if found > key:
                break
            n += 1
        return out


def open_shard(uri: str) -> Reader:
    files, path = fs.FileSystem.from_uri(uri)
    return Reader(files.open_input_file(path), files.get_file_info(path).size)


class LibraryEncoder(Memo):
    """The tokenizers library, asked once for each distinct piece of text between spaces while it is remembered.

    New pieces are handed over as one text, which the library cuts where it would cut them alone; the lengths of the
    tokens tell where each piece ends.
    """

    def __init__(self, path: str, remembered: int = 550_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        before = json.loads(self.lib.to_str())["pre_tokenizer"] or {}
        top = max(self.lib.get_vocab().values()) + 1
        self.lengths = np.zeros(top, np.int64)
        for token, n in self.lib.get_vocab().items():  # in byte-level vocabularies a token has a letter for each byte
            self.lengths[n] = len(token)
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        super().__init__(special, before.get("type") == "ByteLevel" and bool(before.get("use_regex")), remembered)

    def ids_of(self, strings: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        if not spaced:
            found = [e.ids for e in self.lib.encode_batch_fast(strings, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(strings), 4096):
            part = strings[at : at + 4096]
            ids = np.array(self.lib.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy().astype(np.int64) + 1)
            reached = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(reached, ends)
            if not (reached[cuts] == ends).all():
                raise ValueError("the library joined what stands on two sides of a space")
            begin = np.concatenate(([0], cuts[:-1] + 1))
            line = np.fromiter((p[0] == "\n" for p in part), bool, len(part))
            if line.any():  # the space that joined it to the others is a token of its own in front of a line end
                if not (self.lengths[ids[begin[line]]] == 1).all():
                    raise ValueError("the library joined a space and a line end")
                ids = np.delete(ids, begin[line])
            parts.append(ids)
            counts.append(cuts + 1 - begin - line)
        return np.concatenate(parts), np.concatenate(counts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32. Texts with an added token's string go to the library whole."""
        return [x.astype("<u4", copy=False).tobytes() for x in self.ids_of_texts(texts)]


@functools.cache
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_shards(scratch: Scratch, docs: DataFrame, vocab_path: str, end_id: int | None = 2, shard_bytes: int = 256 << 20, rows: int = 4096) -> DataFrame:
    """Encode docs (doc_id, text) and write shards in ascending doc_id; returns their manifest, a written table.

    One row per shard: part, seq (their order is that of the ids), path, docs, ids. Null texts count as empty, null
    ids sort first, and of equal ids all documents are kept, ordered by a hash of their text. A retried task
    writes new files, and only files that the manifest names belong to the table.
    """
    folder = scratch.path("shards")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, shard, stream, name = TaskContext.get().partitionId(), 0, None, None, ""
        files, root = fs.FileSystem.from_uri(folder)
        encoder = library(vocab_path)
        wide = encoder.lib.get_vocab_size(with_added_tokens=True) > 1 << 16 or (end_id or 0) >= 1 << 16
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            shard.finish()
            stream.close()
            return pa.record_batch([[part], [seq], [f"{folder}/{name}"], [shard.docs], [shard.ids]], schema=schema)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True):
                if shard is not None and shard.offset >= shard_bytes:
                    yield close()
                    shard, seq = None, seq + 1
                if shard is None:
                    files.create_dir(root, recursive=True)
                    name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                    stream = files.open_output_stream(f"{root}/{name}")
                    shard = Writer(stream, wide=wide)
                shard.add(key_of(doc_id), np.frombuffer(ids + end, "<u4"))
        if shard is not None:
            yield close()

    return scratch.table(src.mapInArrow(in_batches(run, rows, text=1, most=8 << 20), "part long, seq long, path string, docs long, ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the shards that the manifest names.

    start counts the ids of all documents before it; the running sum over shards takes one row per shard.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                rows, start = [], int(base)
                for key, ids in open_shard(path).scan():
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    n = max(1, manifest.count())
    return shards.repartitionByRange(n, "part", "seq").select("path", "base").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"], dtype=object)
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})
