"""SentencePiece BPE encoding that keeps offsets: every piece has the bytes of the original text that it stands for.

A text is normalised from its start on: the longest prefix that the model's compiled character map has is replaced,
else one character is copied, and of each written character the source offset is kept. Characters are merged by the
scores of the pieces they make, what no piece covers falls back to bytes, and the offsets at a piece's ends are its span.
Where no piece spans the start of a run of white space, and the map is empty, texts are cut there and each distinct
segment is encoded once while it is remembered.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .merging import PairTable
from .segments import Segments, cut_characters, cutter, joined

SPACE = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Normaliser:
    """Longest-prefix replacement by a compiled character map: a double-array trie over UTF-8, and the replacements.

    Fixed format: the trie's size in bytes, its 32-bit units, then strings that end with a zero byte. A unit has a
    label (8 bits and the top one), a flag for a leaf (bit 8), and an offset (bits 10 and up, by bit 9 times 256).
    """

    def __init__(self, charsmap: bytes, dummy: bool, squeeze: bool):
        self.dummy, self.squeeze = dummy, squeeze
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist() if size else []
        self.strings = charsmap[4 + size :]
        self.plain = not self.units and not squeeze

    def longest(self, data: bytes, at: int) -> tuple[int, str | None]:
        """Bytes of the longest prefix at an offset that the map has, and its replacement; 0 and None without one."""
        units, node, best, value = self.units, 0, 0, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for n in range(at, len(data)):
            c = data[n]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best, value = n + 1 - at, units[node] & 0x7FFFFFFF
        if not best:
            return 0, None
        return best, self.strings[value : self.strings.index(b"\0", value)].decode("utf-8")

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normal form, spaces as U+2581, and the source offset in bytes of each of its characters and of its end."""
        out: list[str] = []
        offsets: list[int] = []
        data = text.encode("utf-8")
        at, end = 0, len(data)
        steps = []
        while at < end:
            used, put = self.longest(data, at) if self.units else (0, None)
            if put is None:
                used = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                put = data[at : at + used].decode("utf-8")
            steps.append((at, used, put))
            at += used
        if self.squeeze:
            first = next((n for n, s in enumerate(steps) if s[2] != " "), len(steps))
            steps = steps[first:]
        if not steps:
            return "", [0]
        if self.dummy:
            out.append(SPACE)
            offsets.append(steps[0][0])
        spaced = self.squeeze
        for at, _, put in steps:
            if self.squeeze and spaced:
                put = put.lstrip(" ")
            for c in put:
                out.append(SPACE if c == " " else c)
                offsets.append(at)
            spaced = put.endswith(" ") if put else spaced
        end = steps[-1][0] + steps[-1][1]
        if self.squeeze:
            while out and out[-1] == SPACE:
                out.pop()
                end = offsets.pop()
        return "".join(out), [*offsets, end]


class SentencePieces:
    """Encoder and decoder of a BPE model file with byte fallback of the sentencepiece library."""

    def __init__(self, path: str, remembered: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as files

        model = files.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, spec = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces or any(p.type in (DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, white space in front, and no user-defined or unused pieces")
        self.normaliser = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        pieces = [p.piece for p in model.pieces]
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id_of = {p: n for n, p in enumerate(pieces) if p in scores}
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.is_byte = [p.type == BYTE for p in model.pieces]
        self.byte_ids = {b[0]: n for n, b in enumerate(self.bytes_of) if self.is_byte[n]}
        self.unknown, self.unknown_text = next(n for n, p in enumerate(model.pieces) if p.type == UNKNOWN), trainer.unk_surface
        self.bytes_of[self.unknown] = self.unknown_text.encode()
        if len(self.byte_ids) != 256:
            raise ValueError("byte pieces are missing")
        self.digits = [str(n).encode() for n in range(len(pieces))]
        symbols = dict(self.id_of)  # pieces, then characters that are none
        for c in sorted({c for p in scores for c in p}):
            symbols.setdefault(c, len(pieces) + len(symbols))
        self.symbols = {c: n for c, n in symbols.items() if len(c) == 1}
        self.size = max([len(pieces), *symbols.values()]) + 1
        order = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [(symbols[p[:n]], symbols[p[n:]], order[scores[p]], symbols[p]) for p in scores for n in range(1, len(p)) if p[:n] in symbols and p[n:] in symbols]
        self.table = PairTable(*np.array(pairs or [(0, 0, 0, 0)], np.int64).T, self.size + 1)
        self.lengths = np.ones(self.size + 1, np.int64)  # characters of a symbol; the last one is any other character
        for text, n in symbols.items():
            self.lengths[n] = len(text)
        self.symbol_of = np.full(0x110000, self.size, np.int32)
        for c, n in self.symbols.items():
            self.symbol_of[ord(c)] = n
        safe = cut_characters(p.replace(SPACE, " ").encode() for p in scores) if self.normaliser.plain and self.normaliser.dummy else ""
        self.cuts = safe if " " in safe else ""
        self.memo = _Memo(cutter(self.cuts), self.encode_segments if self.cuts else self.encode_whole, self, remembered)

    def _tokens(self, points: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of normal forms, the source bytes of each, and the numbers of ids; a character's bytes are those of its last byte piece.

        points: the forms' characters, one after another, of which counts has the number in each; offsets: where in the
        source each begins, and the end; those of a form begin where the last one's end.
        """
        tokens, made = self.table.merge_flat(self.symbol_of[points].astype(np.int64), counts)
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        widths = offsets[ends] - offsets[ends - lengths]
        other = np.flatnonzero(tokens >= len(self.bytes_of))
        if len(other):
            data = [chr(c).encode("utf-8") for c in points[ends[other] - 1].tolist()]
            times = np.ones(len(tokens), np.int64)
            times[other] = list(map(len, data))
            owner = np.repeat(np.arange(len(made)), made)
            last = np.cumsum(times) - 1
            tokens = np.repeat(tokens, times)
            for n, d in zip(other.tolist(), data, strict=True):
                tokens[last[n] - len(d) + 1 : last[n] + 1] = [self.byte_ids[x] for x in d]
            spread, widths = widths, np.zeros(len(tokens), np.int64)
            widths[last] = spread
            made = np.bincount(owner, times, len(made)).astype(np.int64)
        return tokens, widths, made

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of segments that begin with the space in front of them, by a map that changes nothing."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sizes = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        normal = np.where(points == 32, ord(SPACE), points)
        return self._tokens(normal, np.fromiter(map(len, segments), np.int64, len(segments)), np.concatenate(([0], np.cumsum(sizes))))

    def encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of whole texts by the character map."""
        found = []
        for text in texts:
            normal, offsets = self.normaliser(text)
            points = np.frombuffer(normal.encode("utf-32-le"), np.uint32)
            found.append(self._tokens(points, np.array([len(points)]), np.array(offsets, np.int64)))
        return tuple(np.concatenate([x[k] for x in found]) for k in range(3))

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        return self.memo.slots([" " + t if t else "" for t in texts] if self.cuts else texts)

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a text, and the start and the end of each in bytes of the text."""
        slots = self.slots([text])[0]
        ids, widths = self.memo.gather(slots)
        start = 0
        if self.cuts and len(ids):  # the space in front is not in the text
            widths[np.flatnonzero(widths)[0] if not self.is_byte[ids[0]] else 0] -= 1
        elif len(ids):
            start = self.normaliser(text)[1][0]
        ends = start + np.cumsum(widths, dtype=np.int64)
        return ids.tolist(), (ends - widths).tolist(), ends.tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: a space in front is that of the model; bytes that are no UTF-8 become U+FFFD each."""
        out: list[str] = []
        held = b""
        bare = True
        for n in [*ids, -1]:
            if n >= 0 and self.is_byte[n]:
                held += self.bytes_of[n]
                continue
            if held:
                out.append(_by_character(held))
                held, bare = b"", False
            if n >= 0:
                part = self.bytes_of[n].decode("utf-8")
                if bare and n != self.unknown and (self.normaliser.dummy or self.normaliser.squeeze) and part.startswith(" "):
                    part = part[1:]
                    bare = self.normaliser.squeeze and not part
                elif part:
                    bare = False
                out.append(part)
        return "".join(out)

    def digest_all(self, texts: list[str]) -> Iterator[tuple[int, str, str, int]]:
        """Of each text: the number of ids, SHA-256 of the ids in decimal and of the text decoded from them, and the bytes that its pieces' spans cover."""
        memo = self.memo
        for slots in self.slots(texts):
            n = int(memo.count[slots].sum())
            ids = hashlib.sha256(joined(memo.printed, slots, b",")).hexdigest()
            if self.cuts:
                text = joined(memo.decoded, slots)[1:]
                covered = int(memo.source[slots].sum()) - bool(n)
            else:
                text = self.decode(memo.gather(slots)[0].tolist()).encode()
                covered = int(memo.source[slots].sum())
            yield n, ids, hashlib.sha256(text).hexdigest(), covered


class _Memo(Segments):
    """Segments with their ids in print, their decoded bytes, and the source bytes they take up."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable, owner: SentencePieces, remembered: int):
        self.owner = owner
        super().__init__(cut, encode, remembered)

    def clear(self) -> None:
        super().clear()
        self.printed: list[bytes] = []
        self.decoded: list[bytes] = []
        self.source = np.zeros(0, np.int64)

    def fresh(self, first: int, ids: list[int], counts: list[int]) -> None:
        digits, data = self.owner.digits, self.owner.bytes_of
        at = 0
        for n in counts:
            some = ids[at : at + n]
            self.printed.append(b",".join([digits[t] for t in some]))
            self.decoded.append(b"".join([data[t] for t in some]))
            at += n
        begin, end = int(self.start[first]), self.used
        owner = np.repeat(np.arange(len(counts)), counts)
        self.source = np.concatenate((self.source, np.bincount(owner, self.widths[begin:end], len(counts)).astype(np.int64)))


def _by_character(data: bytes) -> str:
    """UTF-8 as text, each byte that belongs to no character as U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        return data[: e.start].decode("utf-8") + "�" + _by_character(data[e.start + 1 :])


@functools.cache
def encoder(path: str) -> SentencePieces:
    """One encoder for each worker process and file; tasks drop it when they end."""
    return SentencePieces(path)


def dropped(f: Callable) -> Callable:
    """f over an iterator, with the process's encoders dropped when it ends, fails or is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            encoder.cache_clear()

    return run


def encode(docs: DataFrame, model_path: str, keep: list[str] | None = None, rows: int = 4096) -> DataFrame:
    """The columns in keep, with ids, starts and ends (arrays; spans in bytes of the text) and decoded of every row.

    A null text counts as empty, and an empty one has no pieces.
    """
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for b in batches:
            found = [own.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
            ids, starts, ends = (pa.array([x[k] for x in found], pa.list_(pa.int32() if k == 0 else pa.int64())) for k in range(3))
            decoded = pa.array([own.decode(x[0]) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, starts, ends, decoded], names=[*b.schema.names[:-1], "ids", "starts", "ends", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(in_batches(dropped(run), rows, text=len(keep)), f"{schema}{', ' if schema else ''}ids array<int>, starts array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, model_path: str, rows: int = 4096) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and covered_bytes (of all spans) of every row.

    What encode() returns, reduced in the same pass. A null text counts as empty; a null doc_id stays null; repeated
    rows stay repeated; extra columns are not read. A very long text is one row of one batch; without a place to cut
    it is merged by a heap, in time n log n.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("covered_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for b in batches:
            columns = zip(*own.digest_all(b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return src.mapInArrow(in_batches(dropped(run), rows, text=1), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")


def default_model() -> str:
    """Path of the installed model."""
    import os

    import public_tokenizers

    return os.fspath(public_tokenizers.path("piece_bpe_32k.model"))
