"""A minimal acyclic transducer from words to id sequences, in one file that tasks map into memory.

Words that end alike share states (the automaton is minimal), so a word's output can't hang on its last state. Each
arc instead carries the number of words that sort before it under its state; their sum along a word is the word's rank,
and the rank is the place of its ids.
"""

from __future__ import annotations

import json
import mmap
import struct
from bisect import bisect_left
from collections.abc import Mapping
from pathlib import Path

import numpy as np

_MAGIC = b"MATL"
_PARTS = ("arc_from", "label", "target", "skip", "final", "id_from", "ids")


def compile_lexicon(entries: Mapping[str, tuple[int, ...]]) -> bytes:
    """The file of a lexicon. Words are added in order; when the next word leaves a branch, no later word can change it,
    and its states are replaced from the bottom by equal ones met before."""
    words = sorted(entries)
    states: list[tuple[tuple[tuple[int, int], ...], bool]] = []
    known: dict[tuple, int] = {}
    path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]
    last = ""

    def freeze(depth: int) -> None:
        while len(path) - 1 > depth:
            arcs, final = path.pop()
            key = (tuple(arcs), final)
            if (state := known.get(key)) is None:
                state = known[key] = len(states)
                states.append(key)
            path[-1][0].append((ord(last[len(path) - 1]), state))

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        freeze(shared)
        path.extend(([], False) for _ in word[shared:])
        path[-1] = (path[-1][0], True)
        last = word
    freeze(0)
    root = len(states)
    states.append((tuple(path[0][0]), path[0][1]))

    under = [0] * len(states)
    arc_from, label, target, skip, final = [0], [], [], [], []
    for i, (arcs, ends) in enumerate(states):  # a state's targets come before it
        passed = int(ends)
        for c, to in arcs:
            label.append(c)
            target.append(to)
            skip.append(passed)
            passed += under[to]
        under[i] = passed
        arc_from.append(len(label))
        final.append(ends)
    id_from = np.cumsum([0, *(len(entries[w]) for w in words)])
    ids = [x for w in words for x in entries[w]]
    parts = {"arc_from": np.array(arc_from, "<u4"), "label": np.array(label, "<u4"), "target": np.array(target, "<u4"), "skip": np.array(skip, "<u4"), "final": np.array(final, "u1"), "id_from": id_from.astype("<u4"), "ids": np.array(ids, "<u4")}
    body, places = b"", {}
    for name in _PARTS:
        body += b"\0" * (-len(body) % 8)
        raw = parts[name].tobytes()
        places[name] = (len(body), len(raw), "B" if name == "final" else "I")
        body += raw
    head = json.dumps({"root": root, "words": len(words), "states": len(states), "parts": places}).encode()
    head += b" " * (-len(head) % 8)
    return _MAGIC + struct.pack("<I", len(head)) + head + body


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str | Path):
        with open(path, "rb") as f:
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        if view[:4] != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        (size,) = struct.unpack("<I", view[4:8])
        head = json.loads(bytes(view[8 : 8 + size]))
        body = view[8 + size :]
        self.root, self.words, self.states = head["root"], head["words"], head["states"]
        self.arc_from, self.label, self.target, self.skip, self.final, self.id_from, self.ids = (body[a : a + n].cast(kind) for a, n, kind in (head["parts"][p] for p in _PARTS))

    def get(self, word: str) -> tuple[int, ...] | None:
        """The word's ids, None if the lexicon hasn't the word."""
        state, rank = self.root, 0
        arc_from, label = self.arc_from, self.label
        for c in map(ord, word):
            lo, hi = arc_from[state], arc_from[state + 1]
            i = bisect_left(label, c, lo, hi)
            if i == hi or label[i] != c:
                return None
            rank += self.skip[i]
            state = self.target[i]
        return tuple(self.ids[self.id_from[rank] : self.id_from[rank + 1]]) if self.final[state] else None

    def ranks(self, letters: np.ndarray) -> np.ndarray:
        """Ranks of many words at once, -1 where the lexicon hasn't the word. letters: a row of code points per word, 0 after its end."""
        if not hasattr(self, "_keys"):
            counts = np.diff(np.asarray(self.arc_from).astype(np.int64))
            self._keys = np.repeat(np.arange(len(counts)), counts) << 32 | np.asarray(self.label).astype(np.int64)
        keys, target, skip = self._keys, np.asarray(self.target), np.asarray(self.skip)
        state, rank, rows = np.full(len(letters), self.root, np.int64), np.zeros(len(letters), np.int64), np.arange(len(letters))
        for column in letters.T:
            rows = rows[column[rows] != 0]
            if not len(rows):
                break
            wanted = state[rows] << 32 | column[rows]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1) if len(keys) else np.zeros(len(rows), np.int64)
            hit = keys[at] == wanted if len(keys) else np.zeros(len(rows), bool)
            state[rows[~hit]] = -1
            rows, at = rows[hit], at[hit]
            rank[rows] += skip[at]
            state[rows] = target[at]
        found = (state >= 0) & (np.asarray(self.final)[np.maximum(state, 0)] != 0)
        return np.where(found, rank, -1)

    def ids_at(self, rank: int) -> list[int]:
        return self.ids[self.id_from[rank] : self.id_from[rank + 1]].tolist()
