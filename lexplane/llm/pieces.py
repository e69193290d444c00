"""Encoding by remembered pieces: a batch's texts are cut at spaces and line ends, and each distinct piece is encoded once.

Cutting, finding the distinct pieces and putting the ids together work on a whole batch at once (Arrow and numpy);
Python code runs once for each distinct piece of a batch, and the encoder once for each new one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pre-tokenization pattern of byte-level vocabularies. It cuts at a line end between two other characters.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space in front of a word: pre-tokenization never joins what stands on its two sides.
_BETWEEN = re.compile(r" (?=\S)")
#: A word and the ASCII signs behind it; the apostrophe is left out, as contractions join it to letters.
_TAIL = re.compile(r"(\n?[^\W_]+)([!-&(-/:-@\[-`{-~]+)")
_SIGNS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def spans(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[a : a + n] of each start a and count n, one after another."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(start - ends + count, count) + np.arange(ends[-1])]


class Memo:
    """Ids of pieces by slot. Subclasses encode new ones in ids_of(strings, spaced).

    A piece in `spaced` follows a single space, or is a line end with what follows it; one in `bare` starts a text, or
    is a whole text that has an added token's string. Pieces that white space begins are cut less finely.
    """

    def __init__(self, special: Iterable[str], lines: bool, remembered: int = 800_000):
        """lines: whether a line end between other characters is always a token of its own. remembered: pieces kept
        in each of two generations, and 32 times as many characters besides 4 M; those in use move on to the next, the
        rest are forgotten with theirs."""
        self.special, self.lines, self.remembered = list(special), lines, remembered
        self.spaced: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.age()

    def age(self) -> None:
        """Begin a new generation; the last one stays to be looked up."""
        self.older, self.older_ids, self.older_start, self.older_count = self.spaced, self.ids, self.start, self.count
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.chars = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def ids_of(self, strings: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings, one after another, and how many each has."""
        raise NotImplementedError

    def _put(self, flat: np.ndarray, counts: np.ndarray) -> int:
        """Keep the ids of as many new slots as counts has; the first of them."""
        first, self.n = self.n, self.n + len(counts)
        if self.n > len(self.start):
            self.start, self.count = (np.concatenate((x, np.zeros(max(len(x), self.n - len(x)), np.int64))) for x in (self.start, self.count))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first : self.n], self.count[first : self.n] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(flat)
        return first

    def _store(self, strings: list[str], spaced: bool) -> int:
        """Encode and keep strings, which are distinct and new; the first one's slot."""
        first = self._put(*self.ids_of(strings, spaced)) if strings else self.n
        self.chars += sum(map(len, strings))
        (self.spaced if spaced else self.bare).update(zip(strings, range(first, first + len(strings)), strict=True))
        return first

    def _learn(self, new: list[str]) -> np.ndarray:
        """Slots of new, distinct pieces behind a space. A word and the signs behind it are tokens apart, so each is learned once."""
        out = np.fromiter((self.older.get(p, -1) for p in new), np.int64, len(new)) if self.older else np.full(len(new), -1)
        known = np.flatnonzero(out >= 0)
        if len(known):
            start, count = self.older_start[out[known]], self.older_count[out[known]]
            first = self._put(spans(self.older_ids, start, count), count)
            out[known] = np.arange(first, first + len(known))
            self.spaced.update(zip([new[n] for n in known], range(first, first + len(known)), strict=True))
        rest = np.flatnonzero(out < 0).tolist()
        cut = {n: m for n in rest if new[n][-1] in _SIGNS and (m := _TAIL.fullmatch(new[n]))}
        plain = [n for n in rest if n not in cut]
        first = self._store([new[n] for n in plain], True)
        out[plain] = np.arange(first, first + len(plain))
        if cut:
            words, tails = [m[1] for m in cut.values()], [m[2] for m in cut.values()]
            self._store([w for w in dict.fromkeys(words) if w not in self.spaced], True)
            self._store([t for t in dict.fromkeys(tails) if t not in self.bare], False)
            both = np.array([(self.spaced[w], self.bare[t]) for w, t in zip(words, tails, strict=True)], np.int64)
            first = self._put(self.gather(both.ravel()), self.count[both].sum(1))
            out[list(cut)] = np.arange(first, first + len(cut))
            self.spaced.update(zip([new[n] for n in cut], range(first, first + len(cut)), strict=True))
        return out

    def _heads(self, words: list[str]) -> list[int]:
        self._store([w for w in dict.fromkeys(words) if w not in self.bare], False)
        return [self.bare[w] for w in words]

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of each text's pieces, in order."""
        if self.n > self.remembered or self.used > 16 * self.remembered + (1 << 20) or self.chars > 32 * self.remembered + (4 << 20):
            self.age()
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n") if self.lines else column, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        get = self.spaced.get
        table = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        new = np.flatnonzero(table < 0).tolist()
        coarse = [n for n in new if not self._fine(words[n])]
        head = np.zeros(len(at), bool)
        head[offsets[:-1]] = True
        wanted = np.zeros(len(words), bool)
        slow = special
        if coarse or special.any():
            bad = np.zeros(len(words), bool)
            bad[coarse] = True
            owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
            slow = special | (np.bincount(owner, bad[at] & ~head, len(texts)) > 0)
            wanted[at[~head & ~slow[owner]]] = True
        else:
            wanted[at[~head]] = True
        new = [n for n in new if wanted[n]]
        if new:
            table[new] = self._learn([words[n] for n in new])
        found = table[at]
        quick = np.flatnonzero(~slow)
        found[offsets[:-1][quick]] = self._heads([words[n] for n in at[offsets[:-1][quick]].tolist()])
        out = [found[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for n in np.flatnonzero(slow).tolist():
            if special[n]:
                out[n] = np.array(self._heads([texts[n]]), np.int64)
                del self.bare[texts[n]]
            else:
                first, *rest = _BETWEEN.split(texts[n])
                self._learn([w for w in dict.fromkeys(rest) if w not in self.spaced])
                out[n] = np.array([*self._heads([first]), *map(self.spaced.__getitem__, rest)], np.int64)
        return out

    def _fine(self, piece: str) -> bool:
        """Whether a piece is one as it stands, because no white space precedes it but the space or line end itself."""
        first = piece[1:2] if self.lines and piece[:1] == "\n" else piece[:1]
        return first != "" and not first.isspace()

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of slots, one after another."""
        return spans(self.ids, self.start[slots], self.count[slots])

    def ids_of_texts(self, texts: list[str]) -> list[np.ndarray]:
        found = self.slots(texts)
        if not found:
            return []
        ends = np.cumsum([self.count[s].sum() for s in found])
        return np.split(self.gather(np.concatenate(found)), ends[:-1])
