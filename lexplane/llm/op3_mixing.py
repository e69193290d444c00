"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document's expected copies grow with the square root of its size, up to the limit; whole copies are certain, and the
rest is its inclusion odds in a Pareto sample: documents are ranked by (random odds / inclusion odds) and taken in that
order until the source's words are reached. Where a source's sample ends is found by two levels of histograms of the
rank, then exactly among the few documents of the last cell, so that no task ranks a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, broadcast_if_small

CELLS = 4096
SEED = 20240601


def _order(source: str = "source") -> list[Column]:
    return [F.col(source).isNull().asc(), F.col(source).asc()]


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from sizes (source, size): one row a source.

    Sources in code point order, null last, have the weights in turn. What share * all sizes gives a source above
    limit * its own size goes to the others by weight: with sources by rising (cap / weight), the level at which all
    is given out follows from running sums over the sources.
    """
    by = scratch.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = by.withColumn("n", F.row_number().over(Window.orderBy(*_order())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(limit))
    fill = Window.orderBy(F.col("cap") / F.col("w"), *_order())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    ranked = ranked.withColumn("left", total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(rest))
    ranked = ranked.withColumn("capped", F.col("left") * F.col("w") / F.col("open") >= F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("left") / F.col("open")))).over(Window.partitionBy())["col2"]
    target = F.when(F.col("capped") | level.isNull(), F.col("cap")).otherwise(level * F.col("w"))
    return scratch.table(ranked.select("source", "source_size", target.alias("target")), "targets")


def _expected(scratch: Scratch, sizes: DataFrame, goals: DataFrame, limit: float) -> DataFrame:
    """goals with factor: a document's expected copies are least(limit, factor * sqrt(size)), in words the target in all.

    Solved in closed form from each source's histogram of sizes, largest first.
    """
    hist = scratch.table(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "size-histogram")
    joined = _with(hist, goals, "source").where("target > 0")
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    words, pull = F.col("n") * F.col("size").cast("double"), F.col("n") * F.col("size") * F.sqrt("size")
    joined = joined.withColumn("over", F.coalesce(F.sum(words * limit).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    joined = joined.withColumn("under", F.sum(pull).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    joined = joined.withColumn("factor", (F.col("target") - F.col("over")) / F.col("under"))
    # the first size, from the largest, whose copies stay below the limit
    fits = joined.where(F.col("factor") * F.sqrt("size") < limit).groupBy("source").agg(F.max(F.struct("size", "factor")).alias("s"))
    fits = scratch.table(fits.select("source", F.col("s.factor").alias("factor")), "factors")
    return scratch.table(_with(goals, fits, "source", "left"), "goals")


def _with(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that may be null; right has a row a key, and is broadcast where it is counted to be small."""
    other = broadcast_if_small(right.withColumnRenamed(key, "__key"))
    return left.join(other, F.col(key).eqNullSafe(F.col("__key")), how).drop("__key")


def _ranked(docs: DataFrame, limit: float, seed: int) -> DataFrame:
    """docs (doc_id, source, size, tie, target, factor) with copies (whole), odds left, and the rank t in [0, 1) with its tie-break."""
    e = F.least(F.lit(limit), F.coalesce(F.col("factor") * F.sqrt("size"), F.when(F.col("target") > 0, F.lit(limit)).otherwise(F.lit(0.0))))
    out = docs.withColumn("__e", F.when(F.col("size") > 0, e).otherwise(0.0)).withColumn("whole", F.floor("__e"))
    lam = F.col("__e") - F.col("whole")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "tie"), 11).cast("double") + 0.5) / float(1 << 53)
    # q = (u / (1 - u)) / (lam / (1 - lam)); t = q / (1 + q) has the same order
    t = F.when(lam > 0, u * (1 - lam) / (u * (1 - lam) + (1 - u) * lam))
    return out.withColumn("t", t).drop("__e")


def _cut(scratch: Scratch, ranked: DataFrame) -> DataFrame:
    """(source, t, doc_id, tie): the last document, in rank order, that each source's sample takes; no row: none is taken."""
    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    need = scratch.table(certain.select("source", (F.col("target") - F.col("sure")).alias("need")), "needs")
    pool = ranked.where("t is not null").withColumn("c1", F.floor(F.col("t") * CELLS)).withColumn("c2", F.floor(F.col("t") * CELLS * CELLS) % CELLS)
    state = need.withColumn("below", F.lit(0).cast("long"))
    for level, cells in enumerate((["c1"], ["c1", "c2"])):
        rows = pool if level == 0 else _with(pool, state.withColumnRenamed("c1", "at1"), "source").where("c1 = at1").drop("need", "below", "at1")
        hist = scratch.table(rows.groupBy("source", *cells).agg(F.sum("size").alias("words")), "rank-histogram")
        run = Window.partitionBy("source").orderBy(*cells)
        joined = _with(hist, state.select("source", "need", "below"), "source").withColumn("upto", F.sum("words").over(run) + F.col("below"))
        # the first cell that reaches the need, or the last there is
        cell = joined.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), F.struct(*cells, F.col("upto") - F.col("words")))), F.max(F.struct(*cells, F.col("upto") - F.col("words")))).alias("s"), F.first("need").alias("need"))
        state = scratch.table(cell.select("source", "need", *[F.col(f"s.{c}").alias(c) for c in cells], F.col("s").getField(f"col{len(cells) + 1}").alias("below")), "cells")
    at = state.withColumnRenamed("c1", "at1").withColumnRenamed("c2", "at2")
    last = _with(pool, at, "source").where("c1 = at1 and c2 = at2")
    order = Window.partitionBy("source").orderBy("t", "doc_id", "tie")
    last = last.withColumn("upto", F.sum("size").over(order) + F.col("below"))
    # a document is taken if that brings the words nearer to the need than leaving it
    took = last.where(F.col("upto") - F.col("size") / 2 <= F.col("need"))
    cut = took.groupBy("source").agg(F.max(F.struct("t", "doc_id", "tie")).alias("cut"))
    floor = _with(at, cut, "source", "left").select("source", F.coalesce(F.col("cut.t"), (F.col("at1") * CELLS + F.col("at2")) / float(CELLS * CELLS)).alias("cut_t"), F.col("cut.doc_id").alias("cut_id"), F.col("cut.tie").alias("cut_tie"), F.col("cut").isNotNull().alias("closed"))
    return scratch.table(floor, "cuts")


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie and the whole row, whose own columns may have any names."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie"), F.struct("*").alias("row"))


def _decide(measured: DataFrame, goals: DataFrame, cuts: DataFrame, limit: float, seed: int) -> DataFrame:
    ranked = _ranked(_with(_with(measured, goals, "source"), cuts, "source", "left"), limit, seed)
    lowest = F.lit(-(1 << 63))
    before = F.col("t") < F.col("cut_t")
    at = (F.col("t") == F.col("cut_t")) & F.col("closed") & (F.struct(F.coalesce("doc_id", lowest), "tie") <= F.struct(F.coalesce("cut_id", lowest), "cut_tie"))
    taken = F.coalesce((before | at) & F.col("t").isNotNull(), F.lit(False))
    out = ranked.withColumn("copies", (F.col("whole") + taken.cast("long")).cast("long"))
    return out.drop("tie", "factor", "cut_t", "cut_id", "cut_tie", "closed", "whole", "t")


def decisions(scratch: Scratch, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = SEED, rows: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies; and row, all of it, with rows.

    A null text has no words; null sources are one source, last in order; a document without words is taken 0 times.
    Rows that agree in doc_id and text share a rank and are taken or left together. Runs with the same seed agree.
    Other columns of docs may have any names.
    """
    measured = _measured(docs)
    small = scratch.table(measured.select("doc_id", "source", "size", "tie"), "sizes")
    goals = _expected(scratch, small, targets(scratch, small, weights, share, limit), limit)
    cuts = _cut(scratch, _ranked(_with(small, goals, "source"), limit, seed))
    return _decide(measured if rows else small, goals, cuts, limit, seed)


def mix(scratch: Scratch, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    out = decisions(scratch, docs, rows=True, **options)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
