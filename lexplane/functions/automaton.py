"""Many names found in a text at once: an automaton over all of them, with failure links, that reads each character once."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

#: Characters that equal a letter of ASCII when case is ignored, beside the letter's own two.
_OTHERS = {"\u017f": "s", "\u212a": "k", "\u0130": "i", "\u0131": "i"}
_WORD = re.compile(r"\w")


def _fold(text: str) -> str:
    """Small letters, character by character, so that positions stay."""
    if text.isascii():
        return text.lower()
    return "".join(_OTHERS.get(c) or (low if len(low := c.lower()) == 1 else c) for c in text)


class Names:
    """Names to look for, without regard to case, each apart from longer words: no word character or '/' before, none or '-' behind.

    A state is a prefix of a name; its failure link is the longest other prefix that the text read so far ends with.
    """

    def __init__(self, names: Iterable[str]):
        self.names = [n for n in dict.fromkeys(names) if n]
        self.next: list[dict[str, int]] = [{}]
        self.fail = [0]
        self.ends: list[list[int]] = [[]]  # names that end in a state
        for k, name in enumerate(self.names):
            state = 0
            for c in _fold(name):
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append([])
                state = self.next[state][c]
            self.ends[state].append(k)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            for c, to in self.next[state].items():
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                self.ends[to] = self.ends[to] + self.ends[self.fail[to]]
                todo.append(to)

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, name) of all names, by end; of those of one name that overlap the first."""
        state, last = 0, {}
        follow, fail, ends = self.next, self.fail, self.ends
        for at, c in enumerate(_fold(text), 1):
            while state and c not in follow[state]:
                state = fail[state]
            state = follow[state].get(c, 0)
            for k in ends[state]:
                start = at - len(self.names[k])
                if start < last.get(k, 0) or start and (text[start - 1] == "/" or _WORD.match(text[start - 1])) or at < len(text) and (text[at] == "-" or _WORD.match(text[at])):
                    continue
                last[k] = at
                yield start, at, self.names[k]
