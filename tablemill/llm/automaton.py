"""Suffix automaton of many word sequences, with the least document of every substring.

It is built word by word, then frozen into sorted arrays. ``least`` streams sequences through it, all of a batch side by
side: every state is the longest suffix so far that some reference holds, and its matching statistic
is that suffix's length.
"""

from __future__ import annotations

import numpy as np

from tablemill.llm.shingles import mix

NEVER = np.iinfo(np.int64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Builder:
    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [NEVER]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.low.append(NEVER)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter strings that ``state`` and ``word`` make."""
        copy = self._state(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _target(self, state: int, word: int) -> int:
        target = self.next[state][word]
        return target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)

    def add(self, words: list[int], document: int) -> None:
        follow, link, length, low = self.next, self.link, self.length, self.low
        at = 0
        for word in words:
            target = follow[at].get(word)
            if target is None:
                new, up = len(follow), at
                follow.append({})
                link.append(0)
                length.append(length[at] + 1)
                low.append(document)
                while up >= 0 and word not in follow[up]:
                    follow[up][word] = new
                    up = link[up]
                if up >= 0:
                    link[new] = self._target(up, word)
                at = new
            else:
                at = target if length[target] == length[at] + 1 else self._split(at, word, target)
                if document < low[at]:
                    low[at] = document


def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word + state.astype(np.uint64) * _STEP)


class Automaton:
    def __init__(self, built: Builder):
        low, link = built.low, built.link
        self.link, self.length = np.array(link, np.int32), np.array(built.length, np.int32)
        # what ends a long string ends its suffixes
        for state in np.argsort(-self.length, kind="stable").tolist():
            up = link[state]
            if up >= 0 and low[state] < low[up]:
                low[up] = low[state]
        self.low = np.array(low, np.int64)
        state = np.repeat(np.arange(len(low), dtype=np.int32), [len(n) for n in built.next])
        word = np.array([w for n in built.next for w in n], np.uint64)
        target = np.array([t for n in built.next for t in n.values()], np.int32)
        key = _key(state, word)
        order = np.argsort(key)
        self.key, self.state, self.word, self.target = key[order], state[order], word[order], target[order]

    def _follow(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next state, or -1."""
        if not len(self.key):
            return np.full(len(state), -1, np.int32)
        at = np.minimum(np.searchsorted(self.key, _key(state, word)), len(self.key) - 1)
        return np.where((self.state[at] == state) & (self.word[at] == word), self.target[at], np.int32(-1))

    def least(self, words: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
        """The least document that holds each run of ``window`` words; ``words`` has a row for each sequence."""
        rows, width = words.shape
        low = np.full((rows, max(0, width - window + 1)), NEVER, np.int64)
        state, matched = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
        for i in range(width):
            todo = np.flatnonzero(sizes > i)
            while len(todo):
                to = self._follow(state[todo], words[todo, i])
                found = to >= 0
                state[todo[found]] = to[found]
                matched[todo[found]] += 1
                todo = todo[~found]
                matched[todo[state[todo] == 0]] = 0
                todo = todo[state[todo] > 0]
                state[todo] = self.link[state[todo]]
                matched[todo] = self.length[state[todo]]
            # the state of the last ``window`` words, not of a longer match
            todo = np.flatnonzero(state > 0)
            while len(todo := todo[self.length[self.link[state[todo]]] >= window]):
                state[todo] = self.link[state[todo]]
                matched[todo] = self.length[state[todo]]
            if i >= window - 1:
                full = np.flatnonzero((matched >= window) & (sizes > i))
                low[full, i - window + 1] = self.low[state[full]]
        return low
