"""Texts cut before runs of white space where vocabularies cannot merge across, and segments remembered by slot.

A cut is safe for a vocabulary if none of its entries holds the run's first character behind one that is no white
space: whatever is merged, no token spans the cut. So segments can be encoded alone, each once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

from .pieces import spans

#: White space before which texts may be cut, as far as the vocabularies allow.
CUTS = " \n\t\r\v\f"


def cut_characters(*vocabularies: Iterable[bytes]) -> str:
    """Those of CUTS that stand in no entry of the vocabularies behind what is no white space.

    An entry may begin or end within a character; such bytes count as no white space.
    """
    held: set[str] = set()
    inner = re.compile(rf"(?<=[^\s▁])[{CUTS}]")
    for entries in vocabularies:
        for entry in entries:
            held.update(inner.findall(entry.decode("utf-8", "surrogateescape")))
    return "".join(c for c in CUTS if c not in held)


def cutter(characters: str) -> Callable[[str], list[str]]:
    """A function from a text to its segments: each begins with a run of white space, but the first if none does.

    Only runs that begin with one of the characters are cut at; without any the whole text is one segment. U+2581,
    which piece vocabularies write for a space, counts as white space. An empty text has none.
    """
    if not characters:
        return lambda text: [text] if text else []
    cut = re.escape(characters)
    run = rf"[{cut}][\s▁]*[^{cut}]*"
    rest = rf"(?:(?<=[\s▁]){run})*"
    return re.compile(f"{run}{rest}|[^{cut}]+{rest}").findall


class Segments:
    """Slots of segments, with the ids of each, and the source bytes that each id takes up.

    encode: distinct segments to ids and source bytes, each one after another, and the numbers of ids. Beyond the bounds
    all are forgotten: `remembered` segments, 32 times as many characters and ids.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], remembered: int = 400_000):
        self.cut, self.encode, self.remembered = cut, encode, remembered
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.widths = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of each text's segments, in order; good until the next call."""
        if len(self.slot) > self.remembered or self.held > 32 * self.remembered:
            self.clear()
        found = [self.cut(t) for t in texts]
        slot, new = self.slot, []
        first = len(slot)
        for segments in found:
            for s in segments:
                if s not in slot:
                    slot[s] = len(slot)
                    new.append(s)
        if new:
            ids, widths, counts = self.encode(new)
            n, end = len(slot), self.used + len(ids)
            self.start, self.count = _room(self.start, n), _room(self.count, n)
            self.ids, self.widths = _room(self.ids, end), _room(self.widths, end)
            self.ids[self.used : end], self.widths[self.used : end] = ids, widths
            self.start[first:n], self.count[first:n] = self.used + np.cumsum(counts) - counts, counts
            self.used = end
            self.held += sum(map(len, new)) + len(ids)
            self.fresh(first, ids.tolist(), counts.tolist())
        get = slot.__getitem__
        return [np.fromiter(map(get, segments), np.int64, len(segments)) for segments in found]

    def fresh(self, first: int, ids: list[int], counts: list[int]) -> None:
        """Called with the slots that were added, from first on."""

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slots, one after another, and their source bytes."""
        return spans(self.ids, self.start[slots], self.count[slots]), spans(self.widths, self.start[slots], self.count[slots])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(len(x), n - len(x)), x.dtype)))


def joined(parts: list[bytes], slots: np.ndarray, by: bytes = b"") -> bytes:
    """The parts of the slots, one after another."""
    return by.join(map(parts.__getitem__, slots.tolist()))

