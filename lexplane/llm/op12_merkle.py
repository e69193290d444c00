"""Merkle manifest of a dataset: a tree of digests for each source, one tree over their roots, and a proof for each row.

Leaves are written as runs in order of source and doc_id. A level is made by reading the one below from end to end: 16
consecutive nodes become one as they pass, and only what an end of a run cuts is gathered by a small shuffle. Levels
are partitions of one Parquet table. Proofs are scanned out by coordinate: three levels of a block of 4,096 nodes, and
the block's own path, meet in one task, so nothing is joined row by row and no more than a block is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, whole_runs

FAN, BITS = 16, 4
#: Levels that a block spans.
STOREY = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, n long, pos long, digest string"
PATH = "array<struct<i:int,run:string>>"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each '-' if null, else its bytes in UTF-8, ':' and the value."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, candidate): each row's leaf, and for a fifth of the rows the leaf of a tampered text.

    A row is tampered with where 5 divides the CRC-32 of its decimal doc_id: A-Z become small letters. A null doc_id
    is never tampered with; a null text stays null. The tree is '' for a null source, else '=' and the source.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    of = lambda t: leaf([doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), t])
    tampered = F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, of(F.translate(text, _UPPER, _LOWER)))
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    return docs.select(tree.alias("tree"), doc_id.alias("doc_id"), of(text).alias("digest"), tampered.alias("candidate"))


def placed(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """A table of rows (tree, ...) with n, the rows of its tree, and pos, the place in it by order.

    A tree may span many runs: a run's rows are numbered as they are written, and start behind those of the runs before.
    """
    at = F.expr("monotonically_increasing_id() & 8589934591")
    runs = scratch.table(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).select("*", F.spark_partition_id().alias("run"), at.alias("at")), "runs")
    parts = runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    w = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(w.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.table(parts.select("tree", "run", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n")), "parts")
    out = scratch.table(runs.join(broadcast_if_small(parts), ["tree", "run"]).withColumn("pos", F.col("at") + F.col("shift")).drop("run", "at", "shift"), name)
    for used in (runs, parts):
        scratch.drop(used)
    return out


@dataclass
class Forest:
    """nodes (tree, n, pos, digest, level): n is the number of nodes that a tree has at the level; 1 marks its root."""

    scratch: Scratch
    nodes: DataFrame
    leaves: DataFrame
    depth: int

    def level(self, k: int) -> DataFrame:
        return self.nodes.where(F.col("level") == k).drop("level")

    def roots(self) -> DataFrame:
        """(tree, digest, level) of each tree's root."""
        return self.nodes.where("n = 1").select("tree", "digest", "level")


def _lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in order to their parents as far as all children pass; the others come out as they are, not whole."""
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_())])

    def made(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        t = t.combine_chunks()
        n, pos = t.column("n").to_numpy(), t.column("pos").to_numpy()
        tree = t.column("tree").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((np.diff(pos >> BITS) != 0) | (np.diff(tree) != 0)) + 1))
        ends = np.concatenate((starts[1:], [len(pos)]))
        if not last:
            held, starts, ends = t.slice(int(starts[-1])), starts[:-1], ends[:-1]
        else:
            held = t.slice(0, 0)
        if not len(starts):
            return None, held
        whole = ends - starts == np.minimum(FAN, n[starts] - (pos[starts] >> BITS << BITS))
        digests = t.column("digest").to_pylist()
        parents = [digest("".join(digests[a:b])) for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)]
        cut = np.concatenate([np.arange(a, b) for a, b in zip(starts[~whole], ends[~whole], strict=True)]) if not whole.all() else np.zeros(0, np.int64)
        at = np.concatenate((starts[whole], cut)).astype(np.int64)
        lifted = np.arange(len(at)) < len(parents)
        names = t.column("tree").combine_chunks().take(pa.array(at))
        out = [names, pa.array(np.where(lifted, -(-n[at] // FAN), n[at])), pa.array(np.where(lifted, pos[at] >> BITS, pos[at])), pa.array([*parents, *(digests[k] for k in cut.tolist())], pa.string()), pa.array(lifted)]
        return pa.RecordBatch.from_arrays(out, schema=schema), held

    held: pa.Table | None = None
    for batch in filter(len, batches):
        table = pa.Table.from_batches([batch])
        out, held = made(table if held is None else pa.concat_tables([held, table]), False)
        if out is not None:
            yield out
    if held is not None and held.num_rows:
        out, _ = made(held, True)
        if out is not None:
            yield out


def build(scratch: Scratch, rows: DataFrame, order: list[str]) -> Forest:
    """The trees of rows (tree, digest, ...) by order; each level is written before the next is read from it."""
    spark, root = scratch.spark, scratch.path("nodes")
    leaves = placed(scratch, rows, order, "leaves")
    size = leaves.agg(F.max("n")).first()[0] or 0
    leaves.select("tree", "n", "pos", "digest").write.parquet(f"{root}/level=0")
    level = 0
    while size > 1:
        below = spark.read.schema(NODE).parquet(f"{root}/level={level}").where("n > 1")
        raw = scratch.table(below.mapInArrow(_lift, f"{NODE}, whole boolean"), "lifted")
        gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), "")
        mended = raw.where("not whole").groupBy("tree", F.shiftright("pos", BITS).alias("up")).agg(F.max("n").alias("n"), F.sha2(gathered.cast("binary"), 256).alias("digest"))
        mended = mended.select("tree", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("up").alias("pos"), "digest")
        level += 1
        raw.where("whole").drop("whole").unionByName(mended).write.parquet(f"{root}/level={level}")
        scratch.drop(raw)
        size = -(-size // FAN)
    return Forest(scratch, spark.read.schema(f"{NODE}, level int").option("basePath", root).parquet(root), leaves, level)


def _blocks(t: pa.Table) -> Iterator[tuple[pa.Table, list[tuple[int, str]], dict, list[list[str]], list[int]]]:
    """Of each block in a table of whole ones: its rows of kind 0, its path, the row of it, digests and sizes by level."""
    t = t.combine_chunks()
    key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        block = t.slice(a, b - a)
        kind = block.column("kind").to_numpy()
        by = [np.flatnonzero(kind == k) for k in range(-1, STOREY)]
        top = block.slice(int(by[0][0]), 1).to_pylist()[0]
        levels = [block.column("digest").take(pa.array(x)).to_pylist() for x in by[1:]]
        sizes = [block.column("n")[int(x[0])].as_py() if len(x) else 1 for x in by[1:]]
        yield block.take(pa.array(by[1])), [(s["i"], s["run"]) for s in top["path"]], top, levels, sizes


def _steps(place: int, levels: list[list[str]], sizes: list[int], runs: dict) -> list[tuple[int, str]]:
    """Of the place in a block: at each level the node's number in its run, and the run's digests."""
    out = []
    for k, (digests, n) in enumerate(zip(levels, sizes, strict=True)):
        if n == 1:
            break
        up = place >> BITS
        if (k, up) not in runs:
            runs[k, up] = "".join(digests[up << BITS : (up + 1) << BITS])
        out.append((place & FAN - 1, runs[k, up]))
        place = up
    return out


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path to the root of each node of kind 0."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("path", pa.list_(pa.struct([("i", pa.int32()), ("run", pa.string())])))])
    for table in whole_runs(batches, "key", 4096):
        for rows, upper, top, levels, sizes in _blocks(table):
            runs: dict = {}
            for at in range(0, rows.num_rows, 256):
                some = rows.slice(at, 256)
                found = [[{"i": i, "run": r} for i, r in [*_steps(at + k, levels, sizes, runs), *upper]] for k in range(some.num_rows)]
                yield pa.RecordBatch.from_arrays([some.column("tree").combine_chunks(), some.column("pos").combine_chunks(), pa.array([top["subroot"]] * some.num_rows, pa.string()), pa.array(found, schema.field("path").type)], schema=schema)


def siblings(path: list[tuple[int, str]]) -> str:
    """The digests of a path's siblings, level by level."""
    return "".join(run[: 64 * i] + run[64 * i + 64 :] for i, run in path)


def fold(of: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for i, run in path:
        of = digest(run[: 64 * i] + of + run[64 * i + 64 :])
    return of


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each leaf the digest of its siblings and the root that its candidate, or else itself, folds to."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])
    for table in whole_runs(batches, "key", 4096):
        for rows, upper, top, levels, sizes in _blocks(table):
            runs: dict = {}
            own, candidates = rows.column("digest").to_pylist(), rows.column("candidate").to_pylist()
            proofs, folded = [], []
            for k in range(rows.num_rows):
                path = _steps(k, levels, sizes, runs) + upper
                proofs.append(digest(siblings(path)))
                folded.append(fold(candidates[k] or own[k], path))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(own, pa.string()), pa.array([top["subroot"]] * len(own), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], schema=schema)


def _scan(forest: Forest, base: int, rows: DataFrame, upper: DataFrame) -> DataFrame:
    """Blocks of STOREY levels from base on, in order: key, kind and the columns that the scans read.

    rows (tree, n, pos, digest, doc_id, candidate): the nodes of the base level. upper (tree, block, subroot, path).
    """
    none = lambda t, *names: [F.lit(None).cast(t).alias(x) for x in names]
    parts = []
    for k in range(STOREY):
        if k and base + k > forest.depth:
            break
        nodes = rows if k == 0 else forest.level(base + k).select("*", *none("long", "doc_id"), *none("string", "candidate"))
        parts.append(nodes.select("tree", F.shiftright("pos", BITS * (STOREY - k)).alias("block"), F.lit(k).alias("kind"), "n", "pos", "digest", "doc_id", "candidate", *none("string", "subroot"), *none(PATH, "path")))
    parts.append(upper.select("tree", "block", F.lit(-1).alias("kind"), *none("long", "n", "pos"), *none("string", "digest"), *none("long", "doc_id"), *none("string", "candidate"), "subroot", "path"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("key", F.concat_ws(":", F.col("block").cast("string"), "tree"))
    return out.repartition("key").sortWithinPartitions("key", "kind", "pos")


def _uppers(forest: Forest, ends: DataFrame, base: int, paths: DataFrame | None) -> DataFrame:
    """(tree, block, subroot, path) for the blocks of base: a tree's end if it is in the storey, else the path of the node above."""
    here = ends.where((F.col("level") <= base + STOREY) & (F.col("level") >= base)).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
    return here if paths is None else here.unionByName(paths.select("tree", F.col("pos").alias("block"), "subroot", "path"))


def _descend(forest: Forest, ends: DataFrame) -> DataFrame:
    """The blocks of all leaves in order, for a last scan. ends (tree, level, subroot, path): each tree's root and the path above it."""
    base = (max(forest.depth - 1, 0)) // STOREY * STOREY
    paths: DataFrame | None = None
    while base > 0:
        nodes = forest.level(base).where("n > 1").select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("candidate"))
        upper = _uppers(forest, ends.where(F.col("level") > base), base, paths)
        paths = forest.scratch.table(_scan(forest, base, nodes, upper).mapInArrow(_paths, f"tree string, pos long, subroot string, path {PATH}"), "paths")
        base -= STOREY
    rows = forest.leaves.select("tree", "n", "pos", "digest", "doc_id", "candidate")
    return _scan(forest, 0, rows, _uppers(forest, ends, 0, paths))


def manifest(scratch: Scratch, leaves: DataFrame) -> tuple[Forest, Forest]:
    """The trees of leaves (tree, doc_id, digest, candidate) and the tree over their roots, in order of tree."""
    trees = build(scratch, leaves, ["doc_id", "digest"])
    tops = trees.roots().select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("candidate"))
    return trees, build(scratch, tops, ["name"])


def prove(trees: Forest, top: Forest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf.

    Equal rows are leaves of their own, side by side; rows that share source and doc_id are ordered by digest. Null
    doc_ids come first. Without rows there is no root and the result is empty.
    """
    root = top.roots().first()
    none = F.array().cast(PATH)
    # the top tree's leaves are the trees' roots: their paths are the ends of all other paths
    over = _descend(top, top.roots().select("tree", "level", F.col("digest").alias("subroot"), none.alias("path")))
    found = over.mapInArrow(_paths, f"tree string, pos long, subroot string, path {PATH}").select("pos", "path")
    ends = top.leaves.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(found, "pos")
    ends = trees.scratch.table(ends.join(trees.roots().select("tree", "level"), "tree").select("tree", "level", "subroot", "path"), "ends")
    out = _descend(trees, ends).mapInArrow(_proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    whole = F.lit(root["digest"] if root else None).cast("string")
    return out.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
