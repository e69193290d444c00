"""Merging of neighbouring tokens by rank: of each word the pair of the lowest rank, from the left, until none is left.

Short words of like length go in step (numpy over all of them at once); long ones one at a time by a heap over linked
parts, whose time grows as n log n.
"""

from __future__ import annotations

import heapq

import numpy as np

from .pieces import spans

NEVER = np.iinfo(np.int64).max
#: Parts from which a word is merged with a heap.
LONG = 256


class PairTable:
    """Ranks and results of the pairs of tokens that merge. left, right: tokens of a pair; lower ranks merge first."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, size: int):
        codes = left.astype(np.int64) * size + right
        order = np.argsort(codes, kind="stable")
        self.size, self.codes = size, codes[order]
        self.ranks, self.made_ids = rank[order].astype(np.int64), made[order].astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NEVER where it does not merge or a part is -1."""
        code = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.made_ids[np.searchsorted(self.codes, a * self.size + b)]

    def merge(self, words: list[np.ndarray]) -> list[list[int]]:
        """The exact merging of all words, each given by its first parts."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        tokens, counts = self.merge_flat(np.concatenate(words) if words else np.zeros(0, np.int64), counts)
        found, ends = tokens.tolist(), np.cumsum(counts).tolist()
        return [found[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if words else []

    def merge_flat(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words one after another, of which counts has the parts of each: tokens one after another, and their numbers."""
        starts = np.cumsum(counts) - counts
        made = np.zeros(len(counts), np.int64)
        groups: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.flatnonzero(counts > LONG).tolist():
            tokens = np.array(self._long(flat[starts[n] : starts[n] + counts[n]]), np.int64)
            made[n] = len(tokens)
            groups.append((np.array([n]), tokens))
        order = np.argsort(counts, kind="stable")
        order = order[(counts[order] > 0) & (counts[order] <= LONG)]
        sizes = counts[order]
        at = 0
        while at < len(order):  # words of like length together: padding stays below a half, memory below some 20 MB
            longest = max(16, 2 * int(sizes[at]))
            end = min(int(np.searchsorted(sizes, longest, "right")), at + max(1, 1_000_000 // longest))
            rows = order[at:end]
            width = int(counts[rows].max())
            parts = np.full((len(rows), width + 1), -1, np.int64)
            parts[np.arange(width + 1)[None, :] < counts[rows][:, None]] = spans(flat, starts[rows], counts[rows])
            self._in_step(parts)
            made[rows] = (parts >= 0).sum(1)
            groups.append((rows, parts[parts >= 0]))
            at = end
        out, begin = np.zeros(int(made.sum()), np.int64), np.cumsum(made) - made
        for rows, tokens in groups:
            n = made[rows]
            out[np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(len(tokens))] = tokens
        return out, made

    def _long(self, word: np.ndarray) -> list[int]:
        n = len(word)
        ranks = self.rank_of(word[:-1], word[1:])
        there = np.flatnonzero(ranks < NEVER)
        heap = (ranks[there] * n + there).tolist()
        heapq.heapify(heap)
        at, rank = word.tolist(), [*ranks.tolist(), NEVER]
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        known: dict[int, tuple[int, int]] = {}

        def pair(i: int) -> tuple[int, int]:
            code = at[i] * self.size + at[behind[i]]
            found = known.get(code)
            if found is None:
                k = int(np.searchsorted(self.codes, code))
                hit = k < len(self.codes) and self.codes[k] == code
                found = known[code] = (int(self.ranks[k]), int(self.made_ids[k])) if hit else (NEVER, -1)
            return found

        def look(i: int) -> None:
            rank[i] = NEVER if behind[i] == n else pair(i)[0]
            if rank[i] < NEVER:
                heapq.heappush(heap, rank[i] * n + i)

        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank[i] != r:
                continue
            j = behind[i]
            at[i], at[j], rank[j] = pair(i)[1], -1, NEVER
            behind[i] = behind[j]
            if behind[i] < n:
                before[behind[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
            if len(known) > 500_000:
                known.clear()
        return [t for t in at if t >= 0]

    def _in_step(self, parts: np.ndarray) -> None:
        """Merge each row of parts, which -1 fills up behind; in place."""
        width = parts.shape[1] - 1
        rows = np.arange(len(parts))
        ranks = self.rank_of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), width)
        while True:
            best = ranks[rows].argmin(1)
            live = ranks[rows, best] < NEVER
            rows, best = rows[live], best[live]
            if not len(rows):
                return
            parts[rows, best] = self._made(parts[rows, best], parts[rows, best + 1])
            columns = np.arange(width + 1)[None, :]
            take = np.minimum(columns + (columns > best[:, None]), width)
            parts[rows] = np.take_along_axis(parts[rows], take, 1)
            moved = np.take_along_axis(ranks[rows], np.minimum(take[:, :-1], width - 1), 1)
            moved[:, -1] = NEVER
            at = np.arange(len(rows))
            moved[at, best] = self.rank_of(parts[rows, best], parts[rows, best + 1])
            left = np.maximum(best - 1, 0)
            moved[at, left] = self.rank_of(parts[rows, left], parts[rows, left + 1])
            ranks[rows] = moved
