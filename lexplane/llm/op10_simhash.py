"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Two nodes of the trie are walked down together; each level at which they part costs one of the allowed bits, and a
pair that has overspent is pruned with everything below it. To spread that walk over a cluster, every fingerprint is
dealt to three tries, each of which has another third of the bits on top and walks that third without error: of three
parts, two differing bits leave one untouched, so no link is lost. A subtrie that is still too large has its free bits
parted in three again, until at most 2**10 fingerprints can exist in one. After that deal the tries are small, and what
the walk saves in them is modest; it is the deal that bounds the work.

For looser budgets, in which no part is sure to be free of errors, representatives() takes wide fingerprints of several
words: a trie holds the fingerprints that agree in a random group of bits, the walk prunes on the budget that the
similarity asks for, the whole width decides, and links are held against the shingles themselves. What that leaves out
is found by open_links(): two sets of that similarity share one of their rarest shingles, so of each such shingle all
pairs that are not in one group yet are compared by signatures where they meet, and the clusters that these leave are
held against the shingles, too. No link between groups is lost, and only spanning forests leave either step.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, connected_components, gives_back, in_batches, whole_runs

BUDGET, FREE_BITS = 2, 10
#: Of so many shingles of a set, one more must be shared among the rarest.
PER_MATCH = 100
#: Words of the parities that go along with each of a set's rarest shingles, at most.
MOST_ODD = 128
NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingles(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each of the text's word shingles, repeats included; of all its words, if there are fewer than width."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed integer; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8)).view(">i8")[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles as a signed integer; 0 without words."""
    return majority(shingles(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(in_batches(run, 256), "doc_id long, fp long")


def trie_pairs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within the ranges lo..hi of values that differ in at most budget bits.

    Each range is ascending and without repeats, and is the root of a trie of its own; a node is a range of values
    with a common prefix. All tries are walked in step, a bit a level.
    """
    a = [lo, hi, lo, hi, np.zeros(len(lo), np.int64)]
    out: list[np.ndarray] = []
    for bit in range(63, -1, -1):
        keep = (a[1] - a[0] > 1) | (a[0] != a[2])
        a = [x[keep] for x in a]
        single = (a[1] - a[0] == 1) & (a[3] - a[2] == 1)
        if single.any():
            i, j = a[0][single], a[2][single]
            close = np.bitwise_count(values[i] ^ values[j]) <= budget
            out.append(np.stack([i[close], j[close]]))
            a = [x[~single] for x in a]
        if not len(a[0]):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        amid, bmid = a[1] - (ones[a[1]] - ones[a[0]]), a[3] - (ones[a[3]] - ones[a[2]])
        same = a[0] == a[2]
        spent = a[4] + 1
        nodes = [
            (a[0], amid, a[2], bmid, a[4], np.ones(len(same), bool)),
            (amid, a[1], bmid, a[3], a[4], np.ones(len(same), bool)),
            (a[0], amid, bmid, a[3], spent, spent <= budget),
            (amid, a[1], a[2], bmid, spent, (spent <= budget) & ~same),
        ]
        parts = []
        for alo, ahi, blo, bhi, e, ok in nodes:
            ok = ok & (ahi > alo) & (bhi > blo)
            parts.append([x[ok] for x in (alo, ahi, blo, bhi, e)])
        a = [np.concatenate(x) for x in zip(*parts, strict=True)]
    else:  # below the last bit all nodes are single values
        keep = a[0] != a[2]
        out.append(np.stack([a[0][keep], a[2][keep]]))
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return both.min(0), both.max(0)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes the smallest node linked with it over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for table in whole_runs(batches, "key", 8192):
        key, fp, rep = (table.column(c).to_numpy() for c in ("key", "fp", "rep"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp, rep = key[order], fp[order], rep[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        big = ends - starts > 1
        starts, ends = starts[big], ends[big]
        group = np.cumsum((ends - starts) ** 2) // 4_000_000  # tries that are walked together
        for g in np.unique(group):
            i, j = trie_pairs(fp, starts[group == g], ends[group == g])
            if len(i):
                root = _roots(len(fp), i, j)
                at = np.flatnonzero(root != np.arange(len(fp)))
                yield pa.record_batch([pa.array(rep[at]), pa.array(rep[root[at]])], schema=schema)


def _parts(bits: list[int]) -> list[list[int]]:
    third = -(-len(bits) // 3)
    return [bits[:third], bits[third : third + (len(bits) - third + 1) // 2], bits[third + (len(bits) - third + 1) // 2 :]]


def _masks() -> list[list[tuple[int, int]]]:
    """By level, of every trie: the mask of the bits on top, and its parent's number."""
    levels, free = [], [(0, list(range(64)))]
    while max(len(f) for _, f in free) > FREE_BITS:
        new = [(fixed | sum(1 << x for x in part), n, [x for x in bits if x not in part]) for n, (fixed, bits) in enumerate(free) for part in _parts(bits)]
        levels.append([(fixed, n) for fixed, n, _ in new])
        free = [(fixed, bits) for fixed, _, bits in new]
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, masks: list[tuple[int, int]], parent: str | None) -> DataFrame:
    """Each row once for every mask (of its parent trie's): the trie's number and key."""
    kinds = {}
    for n, (mask, up) in enumerate(masks):
        kinds.setdefault(up, []).append(F.struct(F.lit(n).alias("trie"), F.expr(f"xxhash64({n}, fp & {_signed(mask)}L)").alias("key"), F.expr(f"fp & {_signed(mask)}L").alias("top")))
    if parent is None:
        tries = F.array(*kinds[0])
    else:
        tries = F.when(F.col(parent) == 0, F.array(*kinds[0]))
        for up, structs in kinds.items():
            if up:
                tries = tries.when(F.col(parent) == up, F.array(*structs))
    return rows.select("fp", "rep", F.explode(tries).alias("t")).select("fp", "rep", "t.trie", "t.top", "t.key")


def near_duplicates(scratch: Scratch, fps: DataFrame, most: int = 1 << FREE_BITS) -> DataFrame:
    """fps (doc_id, fp) with component_id: the smallest doc_id reachable over links of at most two differing bits.

    Rows without a doc_id link with nothing and have a null component. Equal fingerprints are one class from the
    start, so a group of copies is one row of the join; of the links in a trie only a spanning forest is returned.
    most: fingerprints in one (sub)trie at most; larger ones are dealt out by further bits, exactly.
    """
    classes = scratch.table(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    levels, ready = _masks(), []
    rows = _deal(classes, levels[0], None)
    for depth in range(len(levels)):
        last = depth + 1 == len(levels)
        sizes = rows.groupBy("trie", "top", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("trie", "top")
        over = None if last else scratch.table(sizes, "large-tries")
        if last or over.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(over, ["trie", "top"], "left_anti"))
        large = rows.join(over, ["trie", "top"], "left_semi").withColumnRenamed("trie", "parent")
        rows = _deal(large, levels[depth + 1], "parent")
    dealt = ready[0].select("key", "fp", "rep")
    for more in ready[1:]:
        dealt = dealt.union(more.select("key", "fp", "rep"))
    edges = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(gives_back(_links), "a long, b long")
    found = connected_components(scratch, edges)
    named = scratch.table(classes.join(found, classes.rep == found.node, "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id")), "components")
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))



def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash: a finalizer of 64-bit mixing functions, started at the k-th of evenly spread offsets."""
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(hashes: np.ndarray, words: int = 4) -> list[int]:
    """A fingerprint of 64 * words bits of a text's shingles, as signed integers; all 0 without words."""
    return [majority(_mixed(hashes, k)) if len(hashes) else 0 for k in range(words)]


def common_shingles(docs: DataFrame, width: int = 5, rows: int = 10_000, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of docs (text) that at least so many of about so many sampled rows have, ascending, and in how many.

    They only order the shingles of a set from rare to frequent; links do not depend on the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n = np.unique(np.concatenate([np.unique(shingles(t.as_py(), width)) for t in b.column(0)]), return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    every = max(1, docs.count() // rows)
    sample = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text", F.lit(every)), F.lit(every)) == 0)
    counts = sample.mapInArrow(in_batches(run, 256), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n")).limit(most).toArrow()
    shingle, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def rarest(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest of a set's hashes (ascending, no repeats), so many that sets of that similarity share enough of theirs.

    Such a set has at least similarity * n of the n hashes. All but one less than that can be left out and one is
    still shared; with n // PER_MATCH more, so many more are shared, by the smaller set's count.
    """
    known, counts = common
    n = len(hashes)
    if not n:
        return hashes
    often = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: n - math.ceil(similarity * n - 1e-6) + 1 + n // PER_MATCH]]


def parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits: whether an odd number of the hashes falls on each. Sets differ in at least as many hashes as in bits."""
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer bits, both counts powers of 2."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def sketches(docs: DataFrame, width: int = 5, words: int = 4, similarity: float = 0.8, common: tuple[np.ndarray, np.ndarray] = NONE) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, tie (a hash of the text), fp array<long>, and of its set of shingles
    digest, size, wide array<long> and odd array<long> (parities of two bits a shingle and more, and of about a quarter of them), rare array<long> (rarest)."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("fp", longs), ("digest", pa.binary()), ("size", pa.int64()), ("wide", longs), ("odd", longs), ("rare", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets = [], []
            for t in b.column(2):
                hashes = shingles(t.as_py(), width)
                fps.append(sketch(hashes, words))
                own = np.unique(hashes)
                wide = parities(own, max(words, 1 << (2 * len(own) // 64).bit_length()))
                odd = folded(wide, min(max(len(wide) // 4, 8), MOST_ODD))
                sets.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), wide, odd, rarest(own, similarity, common).view(np.int64)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, longs), *(pa.array(list(x), f.type) for x, f in zip(zip(*sets, strict=True), list(schema)[3:], strict=True))], schema=schema)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(in_batches(run, 256), "doc_id long, tie long, fp array<long>, digest binary, size long, wide array<long>, odd array<long>, rare array<long>")


def reach(bits: int, similarity: float) -> int:
    """Bits in which fingerprints of that Jaccard similarity differ at most, but for one pair in forty."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of n nodes over edges (i, j) of length d: in rounds, every tree takes its shortest edge."""
    order = np.lexsort((j, i, d))
    i, j, root = i[order], j[order], np.arange(n)
    chosen = [np.zeros((2, 0), np.int64)]
    while True:
        a, b = root[i], root[j]
        on = a != b
        if not on.any():
            return tuple(np.concatenate(chosen, axis=1))
        i, j, a, b = i[on], j[on], a[on], b[on]
        best = np.full(n, len(i))
        np.minimum.at(best, a, np.arange(len(i)))
        np.minimum.at(best, b, np.arange(len(i)))
        pick = np.unique(best[best < len(i)])
        chosen.append(np.stack((i[pick], j[pick])))
        root = _roots(n, a[pick], b[pick])[root]


def _wide(column: pa.ChunkedArray, words: int) -> np.ndarray:
    """Rows of so many words from a column of arrays."""
    return np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in column.chunks]).view(np.uint64).reshape(-1, words)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (key, rows_of_key or null, cls, ...) with block and side: a key of more than most rows is cut into parts, and
    each pair of parts is a block, of which only pairs of differing sides count unless the parts are the same (side 0)."""
    large = F.col("rows_of_key") > most
    rows = rows.withColumn("parts", F.when(large, F.ceil(2 * F.col("rows_of_key") / most)).otherwise(1).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, 0).otherwise(F.when(F.col("part") == low, 1).otherwise(2)).cast("int")
    block = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    return rows.withColumn("block", block).withColumn("side", side).drop("key", "rows_of_key", "parts", "part", "other")


def _candidates(words: int, budget: int, most: int):
    """Batches of blocks to edges (a, b) of a spanning forest of each: pairs within budget bits in the block's word, and within most in all."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block", 8192):
            block, cls, word, side = (table.column(c).to_numpy() for c in ("block", "cls", "word", "side"))
            fps = _wide(table.column("fp"), words)
            value = fps[np.arange(len(fps)), word]
            order = np.lexsort((cls, value, block))
            block, cls, side, fps, value = block[order], cls[order], side[order], fps[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (value[1:] != value[:-1]))))
            count, own = np.diff(np.append(first, len(block))), block[first]
            lo = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            hi = np.append(lo[1:], len(own))
            big = hi - lo > 1
            same = np.flatnonzero(count > 1)  # equal in this word
            pairs = [(same, same)]
            part = np.cumsum((hi[big] - lo[big]) ** 2) // 4_000_000
            pairs += [trie_pairs(value[first], lo[big][part == g], hi[big][part == g], budget) for g in np.unique(part)]
            edges = [np.zeros((3, 0), np.int64)]
            for u, v in pairs:
                sizes = count[u] * count[v]
                for start in range(0, len(u), 1 << 18):
                    n = sizes[start : start + (1 << 18)]
                    which = np.repeat(np.arange(start, start + len(n)), n)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    i, j = first[u[which]] + nth // count[v[which]], first[v[which]] + nth % count[v[which]]
                    on = (i < j) & ((side[i] == 0) | (side[i] != side[j]))
                    i, j = i[on], j[on]
                    d = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64)
                    edges.append(np.stack((i, j, d))[:, d <= most])
            a, b = forest(len(block), *np.concatenate(edges, axis=1))
            if len(a):
                yield pa.record_batch([pa.array(np.minimum(cls[a], cls[b])), pa.array(np.maximum(cls[a], cls[b]))], schema=schema)

    return run


def similar_pairs(scratch: Scratch, classes: DataFrame, similarity: float = 0.8, words: int = 4, groups: int = 36, key_bits: int = 16, most: int = 1 << FREE_BITS, seed: int = 17) -> DataFrame:
    """Candidate links (a, b) of classes (cls, fp array<long>): of each trie a minimum spanning forest over the pairs near enough.

    Every fingerprint is in one trie for each of groups random groups of key_bits bits. A trie of more than most
    fingerprints is cut into parts, and each pair of parts is walked as a trie of its own, so none is left out.
    """
    draw = random.Random(seed)
    masks = [(g % words, sum(1 << b for b in draw.sample(range(64), key_bits))) for g in range(groups)]
    keys = [F.struct(F.lit(k).alias("word"), F.xxhash64(F.lit(g), F.col("fp")[k].bitwiseAND(F.lit(_signed(m)))).alias("key")) for g, (k, m) in enumerate(masks)]
    keyed = classes.select("cls", F.explode(F.array(*keys)).alias("k")).select("k.key")
    large = scratch.table(keyed.groupBy("key").agg(F.count("*").alias("rows_of_key")).where(F.col("rows_of_key") > most), "large-tries")
    rows = classes.select("cls", "fp", F.explode(F.array(*keys)).alias("k")).select("cls", "fp", "k.word", "k.key")
    rows = rows.withColumn("rows_of_key", F.lit(None).cast("long")) if large.isEmpty() else rows.join(broadcast_if_small(large), "key", "left")
    blocks = _blocks(rows, most).select("block", "cls", "word", "side", "fp")
    found = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(gives_back(_candidates(words, reach(64, similarity), reach(64 * words, similarity))), "a long, b long")
    return found.distinct()


class _Parities:
    """Rows of parities of differing widths, all powers of 2."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        self.flat = _wide(column, 1)[:, 0]
        width = pc.list_value_length(column).to_numpy().astype(np.int64)
        self.width, self.start = width[order], (np.cumsum(width) - width)[order]
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows of at least so many words, folded to them, and where each row is among these."""
        if words not in self.at:
            place, parts, have = np.zeros(len(self.width), np.int64), [], 0
            for w in np.unique(self.width[self.width >= words]):
                rows = np.flatnonzero(self.width == w)
                bits = self.flat[self.start[rows][:, None] + np.arange(w)]
                parts.append(np.bitwise_xor.reduce(bits.reshape(len(rows), w // words, words), axis=1))
                place[rows] = have + np.arange(len(rows))
                have += len(rows)
            self.at[words] = np.concatenate(parts), place
        return self.at[words]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits each row i differs from row j, both folded to the fewer words of the two."""
        out, fewer = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for words in np.unique(fewer).tolist():
            (bits, place), on = self._of(words), np.flatnonzero(fewer == words)
            step = max(1, (1 << 19) // words)
            for n in range(0, len(on), step):
                part = on[n : n + step]
                out[part] = np.bitwise_count(bits[place[i[part]]] ^ bits[place[j[part]]]).sum(1, dtype=np.int64)
        return out


def _between(block: np.ndarray, group: np.ndarray, size: np.ndarray, side: np.ndarray, bits: _Parities, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by block and group, pairs (i, j) of one block and differing groups that may have that similarity by
    their sizes and parities, and by how many bits these differ. Sets differ in at least as many shingles."""
    new = block[1:] != block[:-1]
    ends = [np.append(np.flatnonzero(x) + 1, len(block)) for x in (new | (group[1:] != group[:-1]), new)]
    after, last = (np.repeat(x, np.diff(x, prepend=0)) for x in ends)
    partners = last - after  # rows of a block's later groups
    starts = np.flatnonzero(np.diff(np.cumsum(partners) // (1 << 16), prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], len(block)), strict=True):
        n = partners[start:end]
        i = np.repeat(np.arange(start, end), n)
        j = after[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        most = _apart(size[i], size[j], similarity)
        on = (most >= np.abs(size[i] - size[j])) & ((side[i] == 0) | (side[i] != side[j]))
        i, j, most = i[on], j[on], most[on]
        apart = bits.differ(i, j)
        on = apart <= most
        if on.any():
            yield i[on], j[on], apart[on]


def _sorted(table: pa.Table, bits: str) -> tuple[np.ndarray, list[np.ndarray], _Parities]:
    """The order of a table's rows by block and group, and in it block, cls, group, size and side, and the parities."""
    columns = [table.column(c).to_numpy() for c in ("block", "cls", "group", "size", "side")]
    order = np.lexsort((columns[2], columns[0]))
    return order, [x[order] for x in columns], _Parities(table.column(bits), order)


def _between_groups(similarity: float):
    """Batches of blocks to pairs (a, b) of differing groups that share a block's shingle and may have that similarity, with
    n, the shingles found to be shared, and least, how many there must be in all."""
    schema = pa.schema([(x, pa.int64()) for x in ("a", "b", "n", "least")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block", 8192):
            _, (block, cls, group, size, side), bits = _sorted(table, "odd")
            for i, j, _ in _between(block, group, size, side, bits, similarity):
                a, b, least = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), 1 + np.minimum(size[i], size[j]) // PER_MATCH
                order = np.lexsort((b, a))
                a, b, least = a[order], b[order], least[order]
                first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                yield pa.record_batch([pa.array(x) for x in (a[first], b[first], np.diff(np.append(first, len(a))), least[first])], schema=schema)

    return run


def _clusters(similarity: float):
    """Batches of blocks to edges (a, b), fewer than rows: of each block what pairs of differing groups that may have that
    similarity link, a row with the first of its cluster."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block", 8192):
            _, (block, cls, group, size, side), bits = _sorted(table, "odd")
            own = np.arange(len(cls))
            root = own
            for i, j, _ in _between(block, group, size, side, bits, similarity):
                root = _roots(len(cls), np.concatenate((own, i)), np.concatenate((root, j)))
            at = np.flatnonzero(root != own)
            if len(at):
                yield pa.record_batch([pa.array(cls[at]), pa.array(cls[root[at]])], schema=schema)

    return run


def _links_between(similarity: float):
    """Batches of blocks with the shingles of each class to links (a, b), fewer than rows: of each block a spanning forest
    over the groups, nearest pairs first. Every pair that could join two groups is held against the shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block", 256):
            order, (block, cls, group, size, side), bits = _sorted(table, "wide")
            sets = _Parities(table.column("set"), order)
            first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (group[1:] != group[:-1]))))
            root = np.repeat(first, np.diff(np.append(first, len(cls)))).tolist()

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            found = []
            for i, j, apart in _between(block, group, size, side, bits, similarity):
                near = np.argsort(apart, kind="stable")
                for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    if (u := find(x)) != (v := find(y)):
                        mine, other = (sets.flat[sets.start[z] : sets.start[z] + sets.width[z]] for z in (x, y))
                        common = len(np.intersect1d(mine, other, assume_unique=True))
                        if common >= similarity * (len(mine) + len(other) - common):
                            root[u] = v
                            found.append((x, y))
            if found:
                x, y = np.array(found).T
                yield pa.record_batch([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y]))], schema=schema)

    return run


def _apart(x, y, similarity: float):
    """Elements in which sets of x and y elements differ at most if they have that Jaccard similarity."""
    return x + y - 2 * np.ceil((x + y) * (similarity / (1 + similarity)) - 1e-6).astype(np.int64)


def _open_blocks(scratch: Scratch, classes: DataFrame, groups: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, cls, group, size, side, odd) of classes that share one of their rarest shingles with another group, sorted, and the table they read.

    A shingle that only one class has among its rarest, as nearly all have, leaves first; next those of one group leave,
    and only then signatures join. Keys are counted with partial counts and joined back, so that no task holds all rows
    of a frequent one. One with more than most rows is cut into parts, of which each pair is a block.
    """
    rows = classes.select("cls", F.explode("rare").alias("key"))
    counts = scratch.table(rows.groupBy("key").agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1"), "shared-keys")
    shared = rows.join(broadcast_if_small(counts, 200_000), "key").join(groups, F.col("cls") == F.col("node"), "left")
    read = scratch.table(shared.select("key", "rows_of_key", "cls", F.coalesce("component", "cls").alias("group")), "shared-shingles")
    scratch.drop(counts)
    apart = scratch.table(read.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key"), "keys-between-groups")
    shared = read.join(broadcast_if_small(apart, 200_000), "key")
    blocks = _blocks(shared.join(classes.select("cls", "size", "odd"), "cls"), most).select("block", "cls", "group", "size", "side", "odd")
    return blocks.repartition("block").sortWithinPartitions("block"), read


def open_pairs(scratch: Scratch, classes: DataFrame, groups: DataFrame, similarity: float = 0.8, most: int = 1 << FREE_BITS) -> DataFrame:
    """All pairs (a, b) of classes (cls, size, wide, odd, rare) that can have that similarity, but for those within one of groups (node, component).

    Their number grows with the square of a cluster; open_links() returns spanning links instead. Pairs
    must share enough shingles, and their wide parities be near enough.
    """
    pairs = _open_blocks(scratch, classes, groups, most)[0].mapInArrow(gives_back(_between_groups(similarity)), "a long, b long, n long, least long")
    pairs = pairs.groupBy("a", "b", "least").agg(F.sum("n").alias("n")).where("n >= least").select("a", "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = []
            for m, n, x, y in zip(*(b.column(c) for c in ("m", "n", "x", "y")), strict=True):
                x, y = (z.values.to_numpy().view(np.uint64) for z in (x, y))  # of signed integers the bits of the absolute value are counted
                fewer = min(len(x), len(y))
                on.append(np.bitwise_count(folded(x, fewer) ^ folded(y, fewer)).sum() <= _apart(m.as_py(), n.as_py(), similarity))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    sides = [classes.select(F.col("cls").alias(k), F.col("size").alias(n), F.col("wide").alias(w)) for k, n, w in (("a", "m", "x"), ("b", "n", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(gives_back(near), "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, set array<long>): the shingles of the texts of wanted (cls, own)."""
    wanted = wanted.select("cls", F.col("own.doc_id").alias("doc_id"), F.col("own.tie").alias("tie"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    texts = broadcast_if_small(wanted, 100_000).join(texts, ["doc_id", "tie"]).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([np.unique(shingles(t.as_py(), width)).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["cls", "set"])

    return texts.mapInArrow(in_batches(run, 256), "cls long, set array<long>").dropDuplicates(["cls"])


def open_links(scratch: Scratch, docs: DataFrame, classes: DataFrame, groups: DataFrame, similarity: float = 0.8, width: int = 5, most: int = 1 << FREE_BITS, load: int = 1 << 22) -> DataFrame:
    """Links (a, b) of classes (cls, own, size, wide, odd, rare) between groups (node, component), so many that they join whatever any link joins.

    Classes of differing groups that share one of their rarest shingles are compared by sizes and parities where they
    meet. All pairs that may be links lie in one of the clusters that these form, so only edges that span them leave.
    Then every class is in one block, its cluster, with its wide parities and shingles, which decide; again only
    spanning links leave. A cluster with more than load shingles, or most classes, is cut into parts, of which each pair
    is a block.
    """
    blocks, read = _open_blocks(scratch, classes, groups, most)
    clusters = scratch.table(connected_components(scratch, blocks.mapInArrow(gives_back(_clusters(similarity)), "a long, b long")).toDF("cls", "key"), "clusters")
    scratch.drop(read)
    clustered = scratch.table(classes.join(broadcast_if_small(clusters, 100_000), "cls").select("key", "cls", "own", "size", "wide"), "clustered")
    sets = scratch.table(_sets(docs, clustered, width), "shingles")
    weights = clustered.groupBy("key").agg(F.sum(F.col("size") + load // most).alias("rows_of_key")).where(F.col("rows_of_key") > load)
    rows = clustered.join(groups, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("group"), "size", "wide")
    dealt = _blocks(rows.join(broadcast_if_small(weights), "key", "left"), load).join(sets, "cls")
    found = dealt.select("block", "cls", "group", "size", "side", "wide", "set").repartition("block").sortWithinPartitions("block")
    links = scratch.table(found.mapInArrow(gives_back(_links_between(similarity)), "a long, b long"), "links")
    for used in (clusters, clustered, sets):
        scratch.drop(used)
    return links


def _links_among(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of the pairs (a, b) of classes (cls, own) whose texts' sets of shingles have at least that Jaccard similarity."""
    pairs = scratch.table(pairs, "candidates")
    ends = scratch.table(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), "ends")
    sets = scratch.table(_sets(docs, ends.join(classes, "cls"), width), "shingles")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    links = both.select("a", "b", common.alias("c"), total.alias("t")).where(F.col("c") >= F.lit(similarity) * (F.col("t") - F.col("c"))).select("a", "b")
    links = scratch.table(links, "links")
    for used in (pairs, ends, sets):
        scratch.drop(used)
    return links


def representatives(scratch: Scratch, docs: DataFrame, similarity: float = 0.8, width: int = 5, words: int = 4) -> DataFrame:
    """(doc_id, tie, rows): of each group of near copies in docs (doc_id, text) the smallest, and how many rows are equal to it.

    Two texts are linked if their sets of word shingles have at least that Jaccard similarity; groups are all that
    links reach. Fingerprints find most links, open_links() those between the groups so found. Letters A-Z count as
    a-z. Rows without a doc_id are in no group and are not returned; texts without words are copies of each other.
    tie is xxhash64(text), so rows that repeat a doc_id are told apart.
    """
    sk = scratch.table(sketches(docs, width, words, similarity, common_shingles(docs, width)), "sketches")
    first = F.min(F.struct("doc_id", "tie", "fp", "size", "wide", "odd", "rare")).alias("first")
    classes = sk.where("doc_id is not null").groupBy("digest").agg(first).select(F.struct("first.doc_id", "first.tie").alias("own"), "first.*").drop("doc_id", "tie")
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # the numbers are fixed from here on
    rows = scratch.table(sk.groupBy("doc_id", "tie").agg(F.count("*").alias("rows")), "rows")
    scratch.drop(sk)
    links = _links_among(scratch, docs, classes, similar_pairs(scratch, classes, similarity, words), similarity, width)
    groups = scratch.table(connected_components(scratch, links), "groups")
    links = open_links(scratch, docs, classes, groups, similarity, width)
    for k in ("a", "b"):
        links = links.join(groups, F.col(k) == F.col("node"), "left").withColumn(k, F.coalesce("component", k)).select("a", "b")
    joined = connected_components(scratch, links).toDF("group", "larger")
    named = classes.join(groups, F.col("cls") == F.col("node"), "left").select("own", F.coalesce("component", "cls").alias("group")).join(joined, "group", "left")
    named = named.groupBy(F.coalesce("larger", "group").alias("group")).agg(F.min("own").alias("own"))
    return rows.join(named.select(F.col("own.doc_id").alias("doc_id"), F.col("own.tie").alias("tie")), ["doc_id", "tie"])
