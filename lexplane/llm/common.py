"""Shared folder, written intermediate tables, size-checked broadcasts, runs of a key, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words in every text contract here.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a folder made for this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexplane-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


@contextlib.contextmanager
def frees_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files as they end, so that a chain of them needs the disk of the largest, not of all."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


class Scratch:
    """Tables and files of one query below the shared folder; losing an executor loses none of them.

    Results may read them lazily, so they stay until clear() is called by who has used up the result.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lexplane/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0
        Scratch.made.append(self)

    def clear(self) -> None:
        """Delete all of it."""
        self.delete(self.root)
        Scratch.made.remove(self)

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: the lineage ends here and later reads cost a scan."""
        path = self.path(name)
        with frees_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table() whose readers have all run."""
        self.delete(df.scratch_path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = 20_000, cells: Column | None = None, most: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only where df was counted to hold few rows; else the join stays a shuffle join, which adaptive execution splits on hot keys.

    cells: for rows that hold arrays, the elements of each, of which all together may be at most that many.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    return F.broadcast(df) if cells is None or (df.agg(F.sum(cells)).first()[0] or 0) <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole runs from batches sorted by key: a run that a batch boundary cuts is joined again.

    at_least: rows to gather before a table is given out, so that small batches are worked on together.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[-1].as_py()
        if rows >= at_least or rows + batch.num_rows >= at_least:
            start = batch.num_rows
            while start > 0 and keys[start - 1].as_py() == last:
                start -= 1
            before = held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != last
            if start > 0:
                yield pa.Table.from_batches([*held, batch.slice(0, start)])
                held, rows = [batch.slice(start)], batch.num_rows - start
                continue
            if before:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Memory that a task has freed returns to the machine, so that a reused worker holds none of it beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def gives_back(f: Callable) -> Callable:
    """f over an iterator, and give_back() when it ends, fails or is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def in_batches(f: Callable, size: int, text: int | None = None, most: int = 4 << 20) -> Callable:
    """f over an iterator of record batches of at most size rows, so that few long texts are in memory at once.

    text: a string column of which a batch has at most about so many bytes, most, besides one row.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            if text is None:
                ends = []
            else:
                sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype("int64").cumsum()
                ends = [int(n) + 1 for n in (sizes // most)[:-1].astype(bool).nonzero()[0] if sizes[n] // most != (sizes[n - 1] // most if n else 0)]
            for start, end in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                for at in range(start, end, size):
                    yield batch.slice(at, min(size, end - at))

    return gives_back(lambda batches: f(sliced(batches)))


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Minima are pre-aggregated before each
    shuffle; the joins back are plain shuffle joins that adaptive execution splits on a hub. Nothing reaches the
    driver but a count and a checksum of each round. Null nodes and loops are left out.
    """
    spark = scratch.spark
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, before = scratch.table(edges, "edges"), None
    while True:
        print_ = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if print_ == before or print_[0] == 0:
            break
        before = print_
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        star = scratch.table(large, "large")
        low = scratch.table(star.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = star.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = scratch.table(small, "edges")
        for old in (cur, least, star, low):
            scratch.drop(old)
        cur = new
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
