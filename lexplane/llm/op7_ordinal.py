"""Quality classifier: ordinal cumulative-link regression over hashed text.

Grades come from the labels: 0 for low quality, 1 for good quality that is toxic, 2 for good quality that is not. One
weight vector serves all grades; ordered thresholds turn its score f into P(grade > k) = sigmoid(f - theta_k), from
which follow the expected grade and the tail probability that selects documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .labelled import training_rows

DIM, SHAPES = 1 << 16, 4.0
_RUNS = re.compile(r"(.)\1+")
_SHAPE = [(re.compile(p), r) for p, r in ((r"[^\W\d_A-Z]+", "a"), (r"[A-Z]+", "A"), (r"\d+", "0"))]


def slots(token: str, memory: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """Hashed places of a token and of its shape (letters a, capitals A, digits 0, other characters as they are, runs once).

    memory: places known by token, of at most 300,000; the caller's, so that it ends with its task.
    """
    found = memory.get(token)
    if found is None:
        shape = token
        for p, r in _SHAPE:
            shape = p.sub(r, shape)
        shape = _RUNS.sub(r"\1", shape)
        if len(memory) > 300_000:
            memory.clear()
        found = memory[token] = (zlib.crc32(b"w" + token.encode("utf-8", "replace")) % DIM, zlib.crc32(b"s" + shape.encode("utf-8", "replace")) % DIM)
    return found


def features(text: str, memory: dict[str, tuple[int, int]] | None = None) -> dict[int, float]:
    """Hashed features: word counts damped by a square root, shares of shapes, length and repetition in steps."""
    counts = Counter(text.split())
    memory = {} if memory is None else memory
    n = sum(counts.values())
    out: dict[int, float] = {}
    root = math.sqrt(n) if n else 1.0
    for token, c in counts.items():
        w, s = slots(token, memory)
        out[w] = out.get(w, 0.0) + math.sqrt(c) / root
        out[s] = out.get(s, 0.0) + SHAPES * c / n
    for name in (f"length {int(math.log2(n + 1))}", f"distinct {int(10 * len(counts) / max(n, 1))}"):
        k = zlib.crc32(name.encode()) % DIM
        out[k] = out.get(k, 0.0) + 1.0
    return out


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - f[:, None], -30, 30)))

    def score(self, text: str, memory: dict[str, tuple[int, int]] | None = None) -> float:
        w = self.weights
        return float(sum(w[k] * v for k, v in features(text, memory).items()))


def fit(rows: list[tuple[Sequence[int] | np.ndarray, Sequence[float] | np.ndarray, int]], grades: int = 3, steps: int = 120, rate: float = 0.1, l2: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam over (places, values, grade) rows; grades that do not occur are allowed."""
    if not rows:
        return Ordinal(np.zeros(DIM), np.linspace(-1, 1, grades - 1))
    sizes = np.array([len(r[0]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    place, value = np.concatenate([np.asarray(r[0], np.int64) for r in rows]), np.concatenate([np.asarray(r[1]) for r in rows])
    y = np.array([r[2] for r in rows])
    rates = np.array([np.clip((y > k).mean(), 0.01, 0.99) for k in range(grades - 1)])
    start = np.maximum.accumulate(-np.log(rates / (1 - rates)) + 1e-3 * np.arange(grades - 1))
    theta = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    x = np.concatenate((np.zeros(DIM), theta))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        th = np.cumsum(np.concatenate((x[DIM : DIM + 1], np.exp(np.clip(x[DIM + 1 :], -10, 5)))))
        f = np.bincount(owner, value * x[place], len(rows))
        s = 1 / (1 + np.exp(np.clip(th[None, :] - f[:, None], -30, 30)))
        full = np.concatenate((np.ones((len(y), 1)), s, np.zeros((len(y), 1))), 1)
        at = np.arange(len(y))
        upper, lower = full[at, y], full[at, y + 1]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gf = dl - du  # of the negative log likelihood
        gth = np.zeros(grades - 1)
        np.add.at(gth, y[y > 0] - 1, du[y > 0])
        np.add.at(gth, y[y < grades - 1], -dl[y < grades - 1])
        tail = np.cumsum(gth[::-1])[::-1]
        gt = np.concatenate((tail[:1], tail[1:] * np.exp(np.clip(x[DIM + 1 :], -10, 5))))
        g = np.concatenate((np.bincount(place, value * gf[owner], DIM), gt)) / len(y)
        g[:DIM] += l2 * x[:DIM]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    th = np.cumsum(np.concatenate((x[DIM : DIM + 1], np.exp(np.clip(x[DIM + 1 :], -10, 5)))))
    return Ordinal(x[:DIM], th)


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000) -> Ordinal:
    """Fit on at most about rows labelled documents, with all features of each; held-out rows are not read."""
    grade = F.when(F.col("quality").isNull(), None).when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, int]] = {}
        for b in batches:
            ks, vs = [], []
            for t in b.column(0).to_pylist():
                found = features(t, memory)
                ks.append(np.fromiter(found, np.int32, len(found)))
                vs.append(np.fromiter(found.values(), np.float32, len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.list_(pa.int32())), pa.array(vs, pa.list_(pa.float32())), b.column(1)], names=["k", "v", "y"])

    found = training_rows(docs, labels, grade, rows).mapInArrow(in_batches(run, 256), "k array<int>, v array<float>, y int").toArrow()
    return fit([(k.values.to_numpy(), v.values.to_numpy(), y.as_py()) for k, v, y in zip(*(found.column(c) for c in ("k", "v", "y")), strict=True)])


def classify(docs: DataFrame, model: Ordinal, least: float = 0.3) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of at least 1) and kept, of every row.

    Null and empty texts have no words and are scored by that. least: the tail probability from which a document is
    kept. Only doc_id and text are read.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    weights, thresholds = model.weights.astype(np.float32), model.thresholds
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = Ordinal(weights.tolist(), thresholds), {}
        for b in batches:
            tails = own.tails(np.array([own.score(t, memory) for t in b.column(1).to_pylist()], float))
            yield pa.record_batch([b.column(0), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 0] >= least)], schema=schema)

    return src.mapInArrow(in_batches(run, 256), "doc_id long, expected_grade double, tail_probability double, kept boolean")
