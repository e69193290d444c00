"""Structural joins of trees by intervals: nodes and what is asked of them in one sorted stream a document, read once.

A node's descendants have pre in (pre, post]. A stream is sorted by document and pre, so that the nodes around a place
are a stack, and whoever waits for something inside a node meets it as it passes. Work is linear in nodes and results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _packed(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _streamed(stream: DataFrame, order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: S.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return stream.repartition("doc").sortWithinPartitions("doc", *order).mapInArrow(lambda batches: _packed(fold(_rows(batches)), arrow), schema)


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of nodes of a document, the second inside the first: outer (doc, pre, post, ...), inner (doc, pre_in, ...).

    Intervals of outer are a tree's: they nest or lie apart. Rows with a null doc, pre or post pair with nothing.
    """
    kind = outer.schema["doc"].dataType
    o, i = F.struct(*[c for c in outer.columns if c != "doc"]), F.struct(*[c for c in inner.columns if c != "doc"])
    a = outer.where("doc is not null and pre is not null and post is not null").select("doc", F.col("pre").cast("long").alias("at"), F.lit(1).alias("order"), F.col("post").cast("long").alias("end"), o.alias("o"))
    b = inner.where("doc is not null and pre_in is not null").select("doc", F.col("pre_in").cast("long").alias("at"), F.lit(0).alias("order"), i.alias("i"))
    stream = a.unionByName(b, allowMissingColumns=True).select("doc", "at", "order", "end", "o", "i")
    schema = S.StructType([S.StructField("doc", kind), S.StructField("o", stream.schema["o"].dataType), S.StructField("i", stream.schema["i"].dataType)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stack holds places of open nodes; rows themselves stay in Arrow and are taken by their places."""
        now, stack, held = None, [], None
        for b in filter(len, batches):
            docs, at, order, end, outers, inners = b.columns
            around = outers if held is None else pa.concat_arrays([held, outers])
            base, left, right = len(around) - len(b), [], []
            new = [docs[0].as_py() != now, *pc.not_equal(docs[1:], docs[:-1]).to_pylist()]
            for n, (begins, place, kind, last) in enumerate(zip(new, at.to_pylist(), order.to_pylist(), end.to_pylist(), strict=True)):
                if begins:
                    stack = []
                while stack and stack[-1][0] < place:
                    stack.pop()
                if kind == 1:
                    stack.append((last, base + n))
                elif stack:
                    left += [k for _, k in stack]
                    right += [n] * len(stack)
                    if len(left) > 50_000:
                        yield pairs(docs, around, inners, left, right)
                        left, right = [], []
            if left:
                yield pairs(docs, around, inners, left, right)
            now, held = docs[-1].as_py(), around.take(pa.array([k for _, k in stack], pa.int64()))
            stack = [(last, k) for k, (last, _) in enumerate(stack)]

    def pairs(docs: pa.Array, around: pa.Array, inners: pa.Array, left: list[int], right: list[int]) -> pa.RecordBatch:
        inside = pa.array(right, pa.int64())
        return pa.RecordBatch.from_arrays([docs.take(inside), around.take(pa.array(left, pa.int64())), inners.take(inside)], names=["doc", "o", "i"])

    return stream.repartition("doc").sortWithinPartitions("doc", "at", "order").mapInArrow(fold, schema).select("doc", "o.*", "i.*")


def descend(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (doc, id, pre, post, eid, tokens) as (doc, id, eid): from the node at pre down by each token in turn.

    nodes (doc, pre, post, eid, token). A token leads to the first node with it, in document order, inside the node
    reached so far; the first one that is not found ends the way, whatever its length.
    """
    a = asked.select("doc", F.col("pre").cast("long").alias("at"), F.lit(1).alias("order"), F.col("post").cast("long").alias("end"), "eid", F.lit(None).cast("string").alias("token"), "id", "tokens")
    b = nodes.where("token is not null").select("doc", F.col("pre").cast("long").alias("at"), F.lit(0).alias("order"), F.col("post").cast("long").alias("end"), "eid", "token")
    stream = a.unionByName(b, allowMissingColumns=True).select("doc", "at", "order", "end", "eid", "token", "id", "tokens")
    schema = S.StructType([S.StructField("doc", asked.schema["doc"].dataType), S.StructField("id", asked.schema["id"].dataType), S.StructField("eid", S.StringType())])

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        waiting: dict[str, list[tuple]] = {}  # by the token wanted next: end of the node reached, its eid, id, tokens, how many are found

        def left() -> Iterator[tuple]:
            return ((now, id_, eid) for some in waiting.values() for _, eid, id_, _, _ in some)

        for doc, at, order, end, eid, token, id_, tokens in rows:
            if doc != now:
                yield from left()
                now = doc
                waiting.clear()
            if order == 1:
                if tokens and tokens[0] is not None:
                    waiting.setdefault(tokens[0], []).append((end, eid, id_, tokens, 0))
                else:
                    yield doc, id_, eid
                continue
            for end_of, eid_of, one, path, n in waiting.pop(token, ()):
                if end_of < at:
                    yield doc, one, eid_of
                elif n + 1 == len(path) or path[n + 1] is None:
                    yield doc, one, eid
                else:
                    waiting.setdefault(path[n + 1], []).append((end, eid, one, path, n + 1))
        yield from left()

    return _streamed(stream, ["at", "order"], fold, schema)
