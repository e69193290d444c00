"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record with an offset index, read back.

The normaliser inflates each monolithic file once, in chunks; every record becomes a member of its own, and a sidecar
names its offset and length, so that any record can be read with one seek. At no time is more than one record held.
Records of any type and origin are taken: field names are read without regard to case, and ids are kept as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, in_batches

CHUNK = 1 << 20
_LENGTH = re.compile(rb"\r\ncontent-length[ \t]*:[ \t]*(\d+)[ \t]*\r\n", re.I)
_PAGE = re.compile(r"<?urn:page:(-?\d+)>?")


def record(kind: str, uri: str, record_id: str, date: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload and names the record that has it."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by name in lower case, and payload of one record. A line that starts with white space continues the one before."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def split_records(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of a gzip file, whether it is one member or many, inflated once."""
    inflate, held, begun = zlib.decompressobj(31), bytearray(), False
    while data := stream.read(chunk):
        while data:
            begun = True
            held += inflate.decompress(data, chunk)
            yield from _complete(held)
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
            else:
                data = inflate.unconsumed_tail
    if held or begun:
        raise ValueError("the file is cut off")


def _complete(held: bytearray) -> Iterator[bytes]:
    at = 0
    while (end := held.find(b"\r\n\r\n", at)) >= 0:
        length = _LENGTH.search(held, at, end + 2)
        if length is None:
            raise ValueError("a record has no Content-Length")
        stop = end + 4 + int(length[1]) + 4
        if stop > len(held):
            break
        yield bytes(held[at:stop])
        at = stop
    del held[:at]


def revisits(scratch: Scratch, pages: DataFrame, least: int = 100) -> DataFrame:
    """pages (page_id, url, html) with payload digest and length, and refers_to for all but the first of equal payloads.

    Only payloads of at least that many bytes are compared. A null page_id is never referred to; it is a response. Rows
    that repeat both page_id and payload are responses each. The repeated digests are found without the payloads, and
    where they are few the payloads are not shuffled to meet them.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    first = src.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    out = src.join(broadcast_if_small(scratch.table(first, "repeated-payloads"), 50_000), "digest", "left")
    return out.withColumn("refers_to", F.when((F.col("bytes") >= least) & (F.col("page_id") != F.col("first")), F.col("first"))).drop("first")


def write_monolithic(scratch: Scratch, pages: DataFrame, file_bytes: int = 256 << 20) -> DataFrame:
    """Archive files of one gzip stream each, a new one after file_bytes of records; (path) of each, a written table."""
    folder = scratch.path("monolithic")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        out, count, size, name = None, 0, 0, ""
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    files.create_dir(root, recursive=True)
                    name, zipper, count, size = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                payload = row["html"].encode("utf-8", "replace")
                ref = row["refers_to"]
                uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in row["url"])
                data = record("response" if ref is None else "revisit", uri, str(row["page_id"]), "2024-01-01T00:00:00Z", row["digest"], payload if ref is None else b"", len(payload), None if ref is None else str(ref))
                out.write(zipper.compress(data))
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    out.write(zipper.flush())
                    out.close()
                    out = None
                    yield pa.record_batch([[f"{folder}/{name}"], [count]], schema=schema)
        if out is not None:
            out.write(zipper.flush())
            out.close()
            yield pa.record_batch([[f"{folder}/{name}"], [count]], schema=schema)

    chosen = pages.select("page_id", "url", "html", "digest", "refers_to")
    return scratch.table(chosen.mapInArrow(in_batches(run, 64), "path string, records long"), "monolithic-list")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """One row a partition, as each row stands for a file."""
    return df.repartitionByRange(max(1, df.count()), key)


def normalise(scratch: Scratch, archives: DataFrame) -> DataFrame:
    """Rewrite each file of archives (path) with a gzip member a record and a sidecar index; (path, index) of each.

    The index is a text of JSON lines: offset, length, id, type. A record has an id if the archive gave it one.
    """
    folder = scratch.path("normalised")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for path in frame["path"]:
                source, at = fs.FileSystem.from_uri(path)
                files.create_dir(root, recursive=True)
                name, offset = uuid.uuid4().hex, 0
                with source.open_input_stream(at, compression=None) as stream, files.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, files.open_output_stream(f"{root}/{name}.idx") as index:
                    for data in split_records(stream):
                        fields, _ = parse(data)
                        zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = zipper.compress(data) + zipper.flush()
                        out.write(member)
                        index.write((json.dumps({"offset": offset, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}) + "\n").encode())
                        offset += len(member)
                yield pd.DataFrame({"path": [f"{folder}/{name}.warc.gz"], "index": [f"{folder}/{name}.idx"]})

    return scratch.table(_spread(archives, "path").select("path").mapInPandas(run, "path string, index string"), "normalised-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record of archives (path, index): page_id, payload_bytes, payload_digest, record_type, refers_to, offset.

    Records are fetched by the offsets of the index. Length and digest are those of the payload read, and a SHA-256 in
    the header that differs is an error; a revisit, which has no payload, takes them from its header. Records whose id
    is no page's, such as warcinfo, have a null page_id.
    """

    def number(text: str | None) -> int | None:
        found = _PAGE.fullmatch(text or "")
        return int(found[1]) if found else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, index in zip(frame["path"], frame["index"], strict=True):
                files, at = fs.FileSystem.from_uri(path)
                index_files, index_at = fs.FileSystem.from_uri(index)
                rows: list[tuple] = []
                with files.open_input_file(at) as stream, index_files.open_input_stream(index_at, compression=None) as lines:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        stream.seek(entry["offset"])
                        fields, payload = parse(zlib.decompress(stream.read(entry["length"]), 31))
                        said, kind = fields.get("warc-payload-digest", ""), fields.get("warc-type")
                        said = said[7:] if said.lower().startswith("sha256:") else None
                        own, size = hashlib.sha256(payload).hexdigest(), len(payload)
                        if kind == "revisit":
                            own, size = said, int(fields.get("x-payload-length", 0))
                        elif said is not None and own != said and kind == "response" and "x-payload-length" in fields:
                            raise ValueError(f"{path}: the record at {entry['offset']} is damaged")
                        rows.append((number(fields.get("warc-record-id")), size, own, kind, number(fields.get("warc-refers-to")), entry["offset"]))
                        if len(rows) == 5000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
    return _spread(archives, "path").select("path", "index").mapInPandas(run, schema)


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(CHUNK):
        *whole, held = (held + data).split(b"\n")
        yield from whole


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset"]
    return pd.DataFrame(rows, columns=names, dtype=object).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64", "offset": "int64"})
