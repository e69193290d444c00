"""Folders of files: listed by their metadata, written whole from where their rows are, and found again by a manifest."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

MANIFEST = "file string, bytes long, sha256 string"
#: Bytes of files that wait for a batch to be full.
WAITING = 1 << 24


def listing(spark: SparkSession, path: str, pattern: str = "*", hidden: bool = False) -> DataFrame:
    """(file, path, length, modified) of the files below a folder, whose contents are not read. Names that begin with '_' are left out unless hidden."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    name = F.element_at(F.split("path", "/"), -1)
    found = reader.load(path).select(name.alias("file"), "path", "length", F.col("modificationTime").alias("modified"))
    return found if hidden else found.where(~F.col("file").startswith("_"))


def contents(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """(doc, content, xml): files by name with their bytes and the text that they are in UTF-8; names that begin with '_' are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("doc"), "content", F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("xml")).where(~F.col("doc").startswith("_"))


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def texts(manifest: DataFrame, path: str) -> DataFrame:
    """(doc, xml): the files below path that a manifest names, read by name in the tasks, whole as they are; no folder is listed
    and no plan is made for each file. Names that begin with '_' are left out; a file that is not there is an error."""
    base = _qualified(manifest.sparkSession, path)
    schema = pa.schema([("doc", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        for b in batches:
            docs, found, size = [], [], 0
            for file in b.column(0).to_pylist():
                with store.open_input_stream(posixpath.join(root, file)) as f:
                    found.append(f.read())
                docs.append(file)
                size += len(found[-1])
                if size >= WAITING:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(found, pa.binary())], schema=schema)
                    docs, found, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(found, pa.binary())], schema=schema)

    names = spread(manifest.select("file").where(~F.col("file").startswith("_")), "file")
    return names.mapInArrow(run, "doc string, content binary").select("doc", F.col("content").cast("string").alias("xml"))


def write(rows: DataFrame, path: str) -> DataFrame:
    """A file below path for each of rows (file, content binary), and the manifest (MANIFEST) below path/_manifest.

    Each task writes its rows' files under names of their own and renames them when they are whole, so that a task that
    runs again leaves the same files. A repeated name is an error; a null content writes nothing.
    """
    spark = rows.sparkSession
    base = _qualified(spark, path)
    named = rows.select(F.col("file").cast("string").alias("file"), F.col("content").cast("binary").alias("content")).where("content is not null")
    again = named.groupBy("file").count().where("count > 1").first()
    if again is not None:
        raise ValueError(f"file {again[0]} would be written {again[1]} times")
    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not file or "/" in file or file in (".", ".."):
                    raise ValueError(f"not a file name: {file!r}")
                draft = posixpath.join(root, f"_{uuid.uuid4().hex}")
                with store.open_output_stream(draft) as f:
                    f.write(content)
                target = posixpath.join(root, file)
                if store.get_file_info(target).type != fs.FileType.NotFound:  # of an earlier run or attempt
                    store.delete_file(target)
                store.move(draft, target)
                out.append((file, len(content), hashlib.sha256(content).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    spread(named, "file").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{base}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")
