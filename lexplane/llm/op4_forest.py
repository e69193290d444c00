"""Embedding near-duplicates with a forest of random-projection trees.

Each tree splits each label's vectors recursively at the median of a random projection; vectors near the median go to
both sides (spill), so that near pairs are seldom parted: a tenth of the node on either side, and at least what a pair
at the threshold spans on average. A dense node, which such a split leaves with no fewer pairs, is a leaf of any size.
A label that fits a task is one block, in which the task grows all trees and compares within their leaves, so vectors
are shuffled once. Only labels above that bound are split by Spark first, a level at a time over all rows and trees,
until their nodes fit. A pair counts in the first leaf it shares, and links leave a block as one count and one root a
vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, in_batches, whole_runs
from .op10_simhash import _roots

#: Steps in which a large node's distribution is known; rows and columns of a tile of comparisons; levels that Spark splits.
STEPS, TILE, TOP_LEVELS = 20, 1024, 24


def _classes(scratch: Scratch, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows with their class, classes): equal vectors of a label are one class, named by its smallest vec_id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    usable = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull()).where(ok)
    found = scratch.table(usable.groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")), "classes")
    return usable, found


def _projections(classes: DataFrame, trees: int, levels: int, seed: int) -> DataFrame:
    """(cid, label, tree, proj array<float>): of each class's unit vector on a random direction for each tree and level."""
    schema = pa.schema([("cid", pa.int64()), ("tree", pa.int32()), ("proj", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[starts[at][:, None] + np.arange(dim)[None, :]]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if int(dim) not in directions:
                    directions[int(dim)] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), trees * levels))
                p = (x @ directions[int(dim)]).astype(np.float32).reshape(len(at) * trees, levels)
                offsets = pa.array(np.arange(0, p.size + 1, levels), pa.int32())
                yield pa.record_batch([pa.array(np.repeat(ids[at], trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(at))), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], schema=schema)

    out = classes.select("cid", "v").mapInArrow(in_batches(run, 2048), "cid long, tree int, proj array<float>")
    return out


def tops(scratch: Scratch, classes: DataFrame, trees: int, spill: float, levels: int, seed: int, reach: float) -> DataFrame:
    """(cid, leaves array<struct<tree, path, size>>) of classes (cid, path, most, v): nodes of the first levels of all trees.

    A node of more than most classes is split unless levels is reached, or its halves would have as many pairs as the
    node. reach: width of the overlap at least, on the projection. path names a node by a hash of its label and turns.
    """
    known = [0.5 - spill, 0.5, 0.5 + spill, *[k / STEPS for k in range(1, STEPS)]]
    rows = classes.select("cid", "path", "most").join(_projections(classes, trees, levels, seed), "cid").select("cid", "tree", "path", "most", "proj")
    rows, done = scratch.table(rows, "forest"), []
    for level in range(levels + 1):
        p = F.col("proj")[min(level, levels - 1)]
        stats = rows.groupBy("tree", "path").agg(F.count("*").alias("size"), F.percentile_approx(p, known, 500).alias("cut"))
        joined = rows.join(scratch.table(stats, "nodes"), ["tree", "path"])
        mid = F.col("cut")[1]
        lo, hi = F.least(F.col("cut")[0], mid - reach / 2), F.greatest(F.col("cut")[2], mid + reach / 2)
        steps = F.slice("cut", 4, STEPS - 1)
        shares = [(F.size(F.filter(steps, test)) + 0.5) / STEPS for test in (lambda q: q <= hi, lambda q: q >= lo)]  # noqa: B023
        dense = shares[0] * shares[0] + shares[1] * shares[1] >= 1
        small = (F.col("size") <= F.col("most")) | F.lit(level == levels) | dense
        done.append(scratch.table(joined.where(small).select("cid", "tree", "path", "size"), "leaves"))
        if level == levels:
            break
        turns = F.filter(F.array(F.when(p <= hi, F.xxhash64("path", F.lit(level), F.lit(0))), F.when(p >= lo, F.xxhash64("path", F.lit(level), F.lit(1)))), lambda x: x.isNotNull())
        rows = scratch.table(joined.where(~small).select("cid", "tree", F.explode(turns).alias("path"), "most", "proj"), "forest")
        if rows.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    return every.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("tree", "path", "size"))).alias("leaves"))


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int, spill: float, levels: int, reach: float) -> list[np.ndarray]:
    """The leaves of one tree over the rows of x, each as the numbers of its rows."""
    out, open_ = [], [(np.arange(len(x)), 0)]
    while open_:
        rows, level = open_.pop()
        if len(rows) > leaf and level < levels:
            p = x[rows] @ rng.standard_normal(x.shape[1])
            low, mid, high = np.quantile(p, (0.5 - spill, 0.5, 0.5 + spill))
            left, right = p <= max(high, mid + reach / 2), p >= min(low, mid - reach / 2)
            if int(left.sum()) ** 2 + int(right.sum()) ** 2 < len(rows) ** 2:
                open_ += [(rows[left], level + 1), (rows[right], level + 1)]
                continue
        out.append(rows)
    return out


class Links:
    """Links found in one block: pairs at or above the threshold, each counted once."""

    def __init__(self, x: np.ndarray, mult: np.ndarray, threshold: float, names: np.ndarray):
        """names: by row the leaves it is in, ascending and padded with the largest integer; a pair with a common one
        below the leaf at hand has been counted."""
        self.x, self.mult, self.threshold, self.names = x, mult, threshold, names
        self.count, self.edges = np.zeros(len(x), np.int64), [np.zeros((2, 0), np.int64)]

    def compare(self, rows: np.ndarray, others: np.ndarray | None, below: int) -> None:
        """Compare rows with others, or with each other, in tiles."""
        for a in range(0, len(rows), TILE):
            i = rows[a : a + TILE]
            if others is None:
                self._tile(i, i, below, True)
                rest = rows[a + TILE :]
            else:
                rest = others
            for b in range(0, len(rest), TILE):
                self._tile(i, rest[b : b + TILE], below, False)

    def _tile(self, i: np.ndarray, j: np.ndarray, below: int, same: bool) -> None:
        mask = self.x[i] @ self.x[j].T >= self.threshold
        if same:
            mask = np.triu(mask, 1)
        some, other = mask.any(1), mask.any(0)
        if not some.any():
            return
        i, j, mask = i[some], j[other], mask[some][:, other]
        earlier = np.unique(np.intersect1d(self.names[i], self.names[j]))
        earlier = earlier[earlier < below]
        if len(earlier):
            shared = self._has(i, earlier) @ self._has(j, earlier).T > 0
            mask &= ~shared
        np.add.at(self.count, i, mask @ self.mult[j])
        np.add.at(self.count, j, self.mult[i] @ mask)
        if int(mask.sum()) <= 4 * (len(i) + len(j)):
            a, b = np.nonzero(mask)
            self.edges.append(np.stack((i[a], j[b])))
        else:  # a dense tile: the smallest row that reaches each, by rounds over the tile
            big, left, right = len(self.x), i.copy(), np.full(len(j), len(self.x))
            while True:
                to = np.minimum(right, np.where(mask, left[:, None], big).min(0))
                back = np.minimum(left, np.where(mask, to[None, :], big).min(1))
                if (to == right).all() and (back == left).all():
                    break
                left, right = back, to
            linked = right < big
            self.edges += [np.stack((i, left)), np.stack((j[linked], right[linked]))]

    def _has(self, rows: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        names = self.names[rows]
        at = np.minimum(np.searchsorted(earlier, names), len(earlier) - 1)
        out = np.zeros((len(rows), len(earlier)), np.float32)
        row, col = np.nonzero(earlier[at] == names)
        out[row, at[row, col]] = 1
        return out


def _compare(threshold: float, trees: int, leaf: int, spill: float, levels: int, seed: int, reach: float):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    none = np.iinfo(np.int64).max

    def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        col = table.column(name).combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        return col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block", TILE):
            block, cid, mult, side = (table.column(c).to_numpy() for c in ("block", "cid", "n", "side"))
            (flat, starts), (path, path_at) = lists(table, "v"), lists(table, "before")
            begins = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            for s, e in zip(begins, np.append(begins[1:], len(block)), strict=True):
                dim = np.unique(np.diff(starts[s : e + 1]))
                if e - s < 2 or len(dim) > 1:
                    continue
                order = np.argsort(cid[s:e], kind="stable")  # what a task reads first must not matter
                x = flat[starts[s] : starts[e]].reshape(e - s, dim[0])[order]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                owner = np.repeat(np.arange(e - s), np.diff(path_at[s : e + 1]))
                _, name = np.unique(path[path_at[s] : path_at[e]], return_inverse=True)
                place = np.argsort(order)
                owner, tops = place[owner], int(name.max(initial=-1)) + 1
                sides = side[s:e][order]
                if sides.max() > 0 or e - s <= leaf:
                    found = [np.arange(e - s)]
                else:
                    split = tops > 0 or len(owner) > 0
                    rngs = [np.random.default_rng([seed, int(block[s]) & 0xFFFFFFFF, t]) for t in range(2 if split else trees)]
                    found = [rows for rng in rngs for rows in grow(x, rng, leaf, spill, levels, reach)]
                members = np.concatenate([owner, *found])
                numbers = np.concatenate([name, np.repeat(np.arange(tops, tops + len(found)), [len(f) for f in found])])
                by = np.lexsort((numbers, members))
                members, numbers = members[by], numbers[by]
                width = np.bincount(members, minlength=e - s)
                names = np.full((e - s, width.max()), none)
                names[members, np.arange(len(members)) - np.repeat(np.cumsum(width) - width, width)] = numbers
                links = Links(x, mult[s:e][order], threshold, names)
                if sides.max() > 0:  # two parts of one large leaf
                    links.compare(np.flatnonzero(sides == 1), np.flatnonzero(sides == 2), tops)
                else:
                    for n, rows in enumerate(found):
                        links.compare(rows, None, tops + n)
                some = np.flatnonzero(links.count)
                if len(some):
                    i, j = np.concatenate(links.edges, axis=1)
                    root, ids = _roots(e - s, i, j), cid[s:e][order]
                    yield pa.record_batch([pa.array(ids[some]), pa.array(links.count[some]), pa.array(ids[root[some]])], schema=schema)

    return run


def near_duplicates(scratch: Scratch, vectors: DataFrame, threshold: float = 0.93, trees: int = 6, leaf: int = 512, spill: float = 0.1, levels: int = 40, seed: int = 11, cells: int = 4 << 20) -> DataFrame:
    """vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared only within a label, and within a dimension. Null, zero or non-finite vectors, null labels
    and null ids link with nothing; a row without an id has a null component and is kept. Rows with an equal vector
    link with each other, each counted. leaf: classes in a leaf at most, unless levels splits cannot reach that, or a
    node is dense; such a leaf is compared whole. cells: vector components in one task's block at most; larger labels
    are split by Spark first, and a dense node above it is dealt in pairs of parts. Extra columns are not read.
    """
    usable, classes = _classes(scratch, vectors)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    most = F.greatest(F.lit(2), (F.lit(cells) / F.size("v")).cast("long"))
    placed = classes.withColumn("path", F.xxhash64("label", F.size("v"))).withColumn("most", most)
    large = scratch.table(placed.groupBy("path", "most").agg(F.count("*").alias("size")).where("size > most").select("path"), "large-labels")
    columns = ["block", "cid", "n", "v", "before", "side"]
    whole = placed if (none := large.isEmpty()) else placed.join(large, "path", "left_anti")
    blocks = whole.select(F.col("path").alias("block"), "cid", "n", "v", F.array().cast("array<long>").alias("before"), F.lit(0).alias("side"))
    if not none:
        split = scratch.table(placed.join(large, "path", "left_semi"), "large-classes")
        top = split.join(tops(scratch, split, trees, spill, TOP_LEVELS, seed, reach), "cid")
        paths = F.transform("leaves", lambda x: F.xxhash64(x["tree"], x["path"]))
        top = top.withColumn("paths", paths).select("cid", "n", "v", "most", "paths", F.posexplode("leaves").alias("pos", "l"))
        # a node above the bound is cut into k parts; each pair of parts is a block of its own
        k = F.when(F.col("l.size") <= F.col("most"), 1).otherwise(F.ceil(2 * F.col("l.size") / F.col("most"))).cast("int")
        top = top.withColumn("k", k).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
        top = top.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        side = F.when(low == high, 0).otherwise(F.when(F.col("part") == low, 1).otherwise(2)).cast("int")
        before = F.concat(F.slice("paths", F.lit(1), F.col("pos")), F.array(F.xxhash64("cid")))  # its own name marks a row of a split label
        blocks = blocks.union(top.where("l.size > 1").select(F.xxhash64("l.tree", "l.path", low, high).alias("block"), "cid", "n", "v", before.alias("before"), side.alias("side")))
    out = blocks.select(*columns).repartition("block").sortWithinPartitions("block").mapInArrow(_compare(threshold, trees, leaf, spill, levels, seed, reach), "cid long, links long, root long")
    out = scratch.table(out, "links")
    components = connected_components(scratch, out.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = out.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "cid", "left").join(components, F.col("cid") == F.col("node"), "left")
    named = scratch.table(named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")), "named-classes")
    found = usable.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rest = rows.where(~F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ok, F.lit(False)))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
