"""A suffix automaton of several word sequences that knows the first document of each substring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: More than any document id.
NO_DOCUMENT = (1 << 63) - 1


class SuffixAutomaton:
    """States are classes of substrings with the same ends; first[s] is the smallest document that holds those of s."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [NO_DOCUMENT]
        self.words = 0

    def _clone(self, of: int, length: int, p: int, word: int) -> int:
        q = len(self.step)
        self.step.append(self.step[of].copy())
        self.link.append(self.link[of])
        self.length.append(length)
        self.first.append(NO_DOCUMENT)
        self.link[of] = q
        step, link = self.step, self.link
        while p >= 0 and step[p].get(word) == of:
            step[p][word] = q
            p = link[p]
        return q

    def add(self, words: Sequence[int], document: int) -> None:
        step, link, length, first = self.step, self.link, self.length, self.first
        last = 0
        for word in words:
            p = last
            to = step[p].get(word)
            if to is not None:  # an earlier sequence went the same way
                last = to if length[to] == length[p] + 1 else self._clone(to, length[p] + 1, p, word)
            else:
                last = len(step)
                step.append({})
                link.append(0)
                length.append(length[p] + 1)
                first.append(NO_DOCUMENT)
                while p >= 0 and word not in step[p]:
                    step[p][word] = last
                    p = link[p]
                if p >= 0:
                    to = step[p][word]
                    link[last] = to if length[to] == length[p] + 1 else self._clone(to, length[p] + 1, p, word)
            if document < first[last]:
                first[last] = document
        self.words += len(words)

    def close(self) -> None:
        """Gives every class the first document of the longer substrings that end with it."""
        first, link = self.first, self.link
        for s in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]

    def firsts(self, words: Sequence[int], window: int) -> list[int]:
        """For each window of the sequence, the smallest document that holds it (NO_DOCUMENT: none does).

        Matching statistics: the longest suffix of what was read that the automaton knows, cut at the window's length.
        """
        step, link, length, first = self.step, self.link, self.length, self.first
        state, matched = 0, 0
        out = []
        for i, word in enumerate(words):
            while (to := step[state].get(word)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            while length[link[state]] >= window and state:
                state = link[state]
            matched = min(matched, window, length[state])
            if i >= window - 1:
                out.append(first[state] if matched == window else NO_DOCUMENT)
        return out
