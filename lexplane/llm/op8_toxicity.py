"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Lexicons are induced from the learning rows: words and word beginnings that toxic documents have far more often than
others. Their voters, by kind and strength, and pattern voters vote toxic, clean or not at all. The label model
estimates by expectation maximisation how each voter votes on either class, and from the residuals which voters repeat
each other; repeated evidence is weighed down. A logistic regression on lexicon entries and patterns, fitted to the
posterior, then scores whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_batches
from .labelled import held_out, training_rows

BEGINNINGS = (4, 5, 6, 7)
KINDS = ("w", *map(str, BEGINNINGS))
#: Steps of sureness of an entry; toxic documents below which an entry is seen seldom.
SURE, SELDOM = 3, 8
_EDGE = re.compile(r"^\W+|\W+$")
#: Pattern voters; each votes toxic where its test holds.
PATTERNS = {
    "shouting": lambda t, n: sum(map(str.isupper, t)) > 0.5 * max(1, sum(map(str.isalpha, t))),
    "exclaiming": lambda t, n: t.count("!") > 0.2 * n,
    "symbols": lambda t, n: sum(t.count(c) for c in "#*$%&@") > 0.3 * n,
    "addressing": lambda t, n: re.search(r"(?i)\b(?:you|your|du|tu|vous)\b", t) is not None,
    "masking": lambda t, n: re.search(r"\w[*#$@]{2,}\w", t) is not None,
    "repeating": lambda t, n: re.search(r"\b(\w+)(?:\s+\1\b){3}", t) is not None,
    "short": lambda t, n: n < 20,
}


def entries(token: str) -> list[str]:
    """What a token can match: kind and string of the word in lower case and of its beginnings."""
    word = _EDGE.sub("", token).lower()
    if len(word) < 3:
        return []
    return ["w" + word, *[f"{k}{word[:k]}" for k in BEGINNINGS if len(word) > k]]


@dataclass
class Toxicity:
    """The fitted classifier: lexicon entries with their weights, pattern weights, bias."""

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    patterns: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    bias: float = -30.0

    def hits(self, text: str, memory: dict[str, tuple[int, ...]]) -> set[int]:
        """Lexicon entries in a whole text; memory is the caller's, by token."""
        if len(memory) > 300_000:
            memory.clear()
        out: set[int] = set()
        for token in set(text.split()):
            found = memory.get(token)
            if found is None:
                found = memory[token] = tuple(self.lexicon[e] for e in entries(token) if e in self.lexicon)
            if found:
                out.update(found)
        return out

    def score(self, text: str, memory: dict[str, tuple[int, ...]]) -> float:
        x = self.bias + sum(self.weights[k] for k in self.hits(text, memory))
        if (used := np.flatnonzero(self.patterns)).size:
            x += float(self.patterns[used] @ flags(text, used))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def flags(text: str, which: np.ndarray | None = None) -> np.ndarray:
    """Whether each pattern holds, of all or of those whose numbers which has."""
    n, tests = max(1, len(text.split())), list(PATTERNS.values())
    return np.array([bool(tests[k](text, n)) for k in (range(len(tests)) if which is None else which)], float)


def induce(learn: DataFrame, surely: float) -> list[tuple[str, int, int]]:
    """(entry, toxic documents, other documents) of all entries that toxic documents of learn (text, y) have distinctly more often.

    surely: nats of surprise that an entry must be worth; vocabularies are large, and words without meaning abound.
    What is returned is bounded by the rows of learn, as each entry is in several of the toxic ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["entry", "toxic", "other"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for e in {e for token in set(text.split()) for e in entries(token)}:
                    counts.setdefault(e, [0, 0])[int(y > 0)] += 1
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        yield out()

    counted = learn.mapInArrow(in_batches(run, 256), "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    t, o = F.col("toxic").cast("double"), F.col("other").cast("double")
    rate = learn.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    if not rate or rate == 1:
        return []
    # Chernoff's bound: minus the log of the odds that chance alone gives an entry so many toxic documents
    surprise = t * F.log(t / ((t + o) * rate)) + F.when(o > 0, o * F.log(o / ((t + o) * (1 - rate)))).otherwise(0.0)
    best = counted.where((t > 0) & (t / (t + o) > 0.9)).withColumn("surprise", surprise).where(F.col("surprise") >= surely)
    return [tuple(r) for r in best.orderBy(F.col("surprise").desc(), "entry").select("entry", "toxic", "other").collect()]


def voters(lexicon: list[tuple[str, int, int]]) -> np.ndarray:
    """Of each entry the number of its lexicon voter: by kind, and by how sure the entry is (seen seldom, impure, pure)."""
    return np.array([SURE * KINDS.index(e[0]) + (0 if t < SELDOM else 1 + int(o <= 0.02 * t)) for e, t, o in lexicon], int)


def votes(hits: list[set[int]], groups: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rows by voters: 1 toxic, 0 clean, -1 none. Lexicons vote toxic on a hit, their opposites clean without one, patterns toxic."""
    n = SURE * len(KINDS)
    hit = np.zeros((len(hits), n), bool)
    for row, h in enumerate(hits):
        if h:
            hit[row, groups[list(h)]] = True
    none = ~hit.reshape(-1, len(KINDS), SURE).any(2)
    return np.concatenate((np.where(hit, 1, -1), np.where(none, 0, -1), np.where(seen > 0, 1, -1)), 1)


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes; each voter's log odds by vote (none, clean, toxic); its weight.

    Expectation maximisation over P(vote | class), from the majority's start. A voter that agrees with others beyond
    what the class explains gets the weight 1 / (1 + its positive residual correlations).
    """
    prior = min(max(prior, 1e-3), 0.5)
    toxic, clean = (v[:, : SURE * len(KINDS)] == 1).sum(1), (v == 0).sum(1)
    post = np.where(toxic > 0, 0.9, np.where(clean > 0, 0.02, prior)).astype(float)
    weight = np.ones(v.shape[1])
    odds = np.zeros((v.shape[1], 3))
    for _ in range(rounds):
        for k in range(3):
            seen = v == k - 1
            odds[:, k] = np.log((post @ seen + 0.1) / (post.sum() + 0.3)) - np.log(((1 - post) @ seen + 0.1) / ((1 - post).sum() + 0.3))
        x = np.stack([odds[j, v[:, j] + 1] for j in range(v.shape[1])], 1)
        mean = np.outer(post, post @ x / max(post.sum(), 1e-9)) + np.outer(1 - post, (1 - post) @ x / max((1 - post).sum(), 1e-9))
        rest = x - mean
        norm = np.sqrt((rest * rest).sum(0))
        corr = (rest.T @ rest) / np.maximum(np.outer(norm, norm), 1e-9)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.maximum(corr, 0).sum(1))
        z = np.log(prior / (1 - prior)) + x @ weight
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, odds, weight


def fit_linear(hits: list[set[int]], seen: np.ndarray, post: np.ndarray, size: int, steps: int = 300, rate: float = 0.1, l2: float = 1e-5, l1: float = 2e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels; weights of entries (never below 0), of patterns (sparse by l1), and the bias."""
    owner = np.array([row for row, h in enumerate(hits) for _ in h], int)
    place = np.array([k for h in hits for k in h], int)
    x = np.zeros(size + len(PATTERNS) + 1)
    x[-1] = -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        f = np.bincount(owner, x[place], len(hits)) + seen @ x[size:-1] + x[-1]
        d = 1 / (1 + np.exp(-np.clip(f, -30, 30))) - post
        g = np.concatenate((np.bincount(place, d[owner], size), seen.T @ d, [d.sum()])) / len(hits) + l2 * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x[:size] = np.maximum(x[:size], 0)
        x[size:-1] = np.sign(x[size:-1]) * np.maximum(np.abs(x[size:-1]) - rate * l1, 0)
    return x[:size], x[size:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = 12_000, surely: float = 10.0) -> Toxicity:
    """Fit on at most about rows labelled documents that are not held out; without toxic ones every score is 0.

    What reaches the driver is bounded by rows: the lexicon, and for each learning row its hits and patterns.
    """
    learn = training_rows(docs, labels, F.when(F.col("toxic").isNotNull(), (F.col("toxic") > 0).cast("int")), rows)
    found = induce(learn, surely)
    if not found:
        return Toxicity()
    model = Toxicity({e: n for n, (e, _, _) in enumerate(found)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.record_batch([pa.array([sorted(model.hits(t, memory)) for t in texts], pa.list_(pa.int32())), pa.array([flags(t).astype(int).tolist() for t in texts], pa.list_(pa.int32())), b.column(1)], names=["hits", "flags", "y"])

    sample = learn.mapInArrow(in_batches(run, 256), "hits array<int>, flags array<int>, y int").toArrow().to_pydict()
    order = sorted(range(len(sample["y"])), key=lambda n: (sample["hits"][n], sample["flags"][n], sample["y"][n]))  # reruns agree
    hits, seen = [set(sample["hits"][n]) for n in order], np.array([sample["flags"][n] for n in order], float)
    post, _, _ = label_model(votes(hits, voters(found), seen), float(np.mean(sample["y"])))
    model.weights, model.patterns, model.bias = fit_linear(hits, seen, post, len(found))
    return model


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text counts as empty. Only doc_id and text are read."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.score(t, memory) for t in b.column(1).to_pylist()], pa.float64())], schema=schema)

    scored = src.mapInArrow(in_batches(run, 256), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns; texts are scored where they are, without a join."""
    src = docs.withColumn(fresh(docs, "__scored"), F.coalesce(F.col("text").cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            keep = pa.array([model.score(t, memory) < threshold for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(keep)

    return src.mapInArrow(in_batches(run, 256), docs.schema)
