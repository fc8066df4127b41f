"""A wavelet matrix of token ids in one compressed file: access, counting and occurrences without unpacking it.

Ids are Huffman codes, so frequent ones take few bits. Bit-plane p holds bit p of every code that is longer than p, in the
order in which the planes above left them: codes with bit 0 first, then those with bit 1, each in their order. Codes are
dealt so that those which end at a plane come last below it, in the order of their symbols: there the plane is cut off, and the
place of an id among them tells which it is. Planes lie in the file as 64-bit words beside a directory of ones before each
65,536 bits and, within those, before each 512 bits. They are used where they lie, in bytes or in a memory map: one access, rank or
select looks at two directory entries and eight words of each plane.
"""

from __future__ import annotations

import heapq
import json
import struct

import numpy as np
import zstandard

_MAGIC = b"WVM2"
_SUPER, _BLOCK = 1 << 16, 512


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of Huffman codes for symbols met so often; at least one bit."""
    if len(counts) < 2:
        return np.ones(len(counts), np.int64)
    up = np.zeros(2 * len(counts) - 1, np.int64)
    heap = [(c, i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    for node in range(len(counts), len(up)):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[1]] = up[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
    depth = np.zeros(len(up), np.int64)
    for node in range(len(up) - 2, -1, -1):
        depth[node] = depth[up[node]] + 1
    return depth[: len(counts)]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Codes, with their first bit highest of 32, of symbols in ascending order of length: below each plane those that end come last."""
    out = np.zeros(len(lengths), np.uint32)
    open_ = np.zeros(1, np.uint32)
    for p in range(int(lengths.max(initial=0))):
        open_ = np.concatenate([open_, open_ | np.uint32(1 << (31 - p))])
        ends = np.flatnonzero(lengths == p + 1)
        out[ends] = open_[len(open_) - len(ends) :]
        open_ = open_[: len(open_) - len(ends)]
    return out


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: ids of its documents one after another; doc_ids and lengths in the same order."""
    pack = zstandard.ZstdCompressor(level=1)
    body: list[bytes] = []
    place = 0

    def put(array: np.ndarray, compress: bool = False) -> tuple[int, int]:
        nonlocal place
        raw = pack.compress(array.tobytes()) if compress else array.tobytes()
        body.append(raw + bytes(-len(raw) % 8))
        place += len(body[-1])
        return place - len(body[-1]), len(raw)

    met = np.bincount(ids)
    symbols = np.flatnonzero(met)
    bits = code_lengths(met[symbols])
    order = np.argsort(bits, kind="stable")
    symbols, bits = symbols[order], bits[order]
    counts = met[symbols]
    code_of = np.zeros(len(met), np.uint32)
    code_of[symbols] = codes_of(bits)
    row = code_of[ids]
    planes = []
    for p in range(int(bits.max(initial=0))):
        ones = (row & np.uint32(1 << (31 - p))) != 0
        words = np.zeros(-(-len(row) // _BLOCK) * _BLOCK // 8, np.uint8)
        packed = np.packbits(ones, bitorder="little")
        words[: len(packed)] = packed
        each = np.bitwise_count(words.view("<u8")).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        before = np.cumsum(each) - each
        supers = before[:: _SUPER // _BLOCK]
        within = (before - np.repeat(supers, _SUPER // _BLOCK)[: len(before)]).astype("<u2")
        rest = row[~ones]
        planes.append({"n": len(row), "zeros": len(rest), "words": put(words), "supers": put(supers.astype("<u8")), "blocks": put(within)})
        row = np.concatenate([rest, row[ones]])[: len(row) - int(counts[bits == p + 1].sum())]
    known = np.array([d is not None for d in doc_ids], bool)
    held = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = {
        "n": len(ids), "documents": len(doc_ids), "planes": planes, "symbols": put(symbols.astype("<u4"), True), "counts": put(counts.astype("<u8"), True), "bits": put(bits.astype("u1"), True),
        "ids": put(np.diff(held, prepend=np.int64(0)), True), "known": put(np.packbits(known), True), "lengths": put(np.array(lengths, "<i8"), True),
    }
    directory = pack.compress(json.dumps(head).encode())
    return _MAGIC + struct.pack("<I", len(directory)) + directory + bytes(-len(directory) % 8) + b"".join(body)


class WaveletMatrix:
    """A shard's file, as bytes or a memory map. Positions count from 0; ranges are half open."""

    def __init__(self, file: bytes | memoryview):
        view = memoryview(file)
        if view[:4] != _MAGIC:
            raise ValueError("no wavelet matrix")
        (size,) = struct.unpack("<I", view[4:8])
        self._unpack = zstandard.ZstdDecompressor()
        head = json.loads(self._unpack.decompress(view[8 : 8 + size]))
        self._body = view[8 + size + -size % 8 :]
        self.n, self.documents, self._planes, self._head = head["n"], head["documents"], head["planes"], head
        self.symbols, self._counts, bits = self._array("symbols", "<u4"), self._array("counts", "<u8").astype(np.int64), self._array("bits", "u1")
        self._codes = codes_of(bits)
        self._of = {int(s): i for i, s in enumerate(self.symbols)} if len(self.symbols) else {}
        self._bits = bits.astype(np.int64)
        #: Per plane: symbols whose codes end there, as a range of symbols.
        cuts = np.searchsorted(self._bits, np.arange(len(self._planes) + 2))
        self._ending = [slice(int(cuts[p + 1]), int(cuts[p + 2])) for p in range(len(self._planes))]
        self._words = [np.frombuffer(self._body, "<u8", p["words"][1] // 8, p["words"][0]) for p in self._planes]
        self._supers = [np.frombuffer(self._body, "<u8", p["supers"][1] // 8, p["supers"][0]).view(np.int64) for p in self._planes]
        self._blocks = [np.frombuffer(self._body, "<u2", p["blocks"][1] // 2, p["blocks"][0]) for p in self._planes]

    def _array(self, name: str, kind: str) -> np.ndarray:
        at, size = self._head[name]
        return np.frombuffer(self._unpack.decompress(self._body[at : at + size]), kind)

    def _before(self, p: int, block: np.ndarray) -> np.ndarray:
        """Ones before blocks of plane p."""
        return self._supers[p][block // (_SUPER // _BLOCK)] + self._blocks[p][block]

    def _rank(self, p: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits of plane p, for each i."""
        n = self._planes[p]["n"]
        if not n:
            return np.zeros_like(i)
        block = np.minimum(i, n - 1) // _BLOCK
        kept = np.clip((i - block * _BLOCK)[:, None] - 64 * np.arange(8), 0, 64).astype(np.uint64)
        mask = np.where(kept == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(kept, np.uint64(63))) - np.uint64(1))
        words = self._words[p][block[:, None] * 8 + np.arange(8)]
        return self._before(p, block) + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def _bit(self, p: int, i: np.ndarray) -> np.ndarray:
        return (self._words[p][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def _select(self, p: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) bits of that value in plane p, for each k."""
        blocks = np.arange(len(self._blocks[p]))
        before = self._before(p, blocks)
        if not bit:
            before = blocks * _BLOCK - before
        out = []
        for part in np.array_split(k, -(-len(k) // 8192)) if len(k) else []:
            block = np.searchsorted(before, part, "right") - 1
            words = self._words[p][block[:, None] * 8 + np.arange(8)]
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            out.append(block * _BLOCK + (np.cumsum(bits == bit, axis=1) > (part - before[block])[:, None]).argmax(axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def access_many(self, positions: np.ndarray) -> np.ndarray:
        """Ids at positions."""
        at = np.asarray(positions, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(positions)
        out, left = np.zeros(len(at), np.uint32), np.arange(len(at))
        for p, plane in enumerate(self._planes):
            ones, bit = self._rank(p, at), self._bit(p, at)
            at = np.where(bit, plane["zeros"] + ones, at - ones)
            ending = self._ending[p]
            last = plane["n"] - int(self._counts[ending].sum())
            done = at >= last
            if done.any():
                out[left[done]] = self.symbols[ending][np.searchsorted(np.cumsum(self._counts[ending]), at[done] - last, "right")]
                at, left = at[~done], left[~done]
            if not len(left):
                break
        return out

    def access(self, i: int) -> int:
        return int(self.access_many(np.array([i]))[0])

    def _path(self, token: int) -> list[int]:
        i = self._of[token]
        return [int(self._codes[i]) >> (31 - p) & 1 for p in range(int(self._bits[i]))]

    def _narrow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of token among [lo, hi) lie below the last plane of its code."""
        for p, bit in enumerate(self._path(token)):
            a, b = self._rank(p, np.array([lo, hi])).tolist()
            lo, hi = (self._planes[p]["zeros"] + a, self._planes[p]["zeros"] + b) if bit else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        if token not in self._of:
            return 0
        a, b = self._narrow(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of token in [lo, hi), ascending."""
        if token not in self._of:
            return np.zeros(0, np.int64)
        found = np.arange(*self._narrow(token, lo, self.n if hi is None else hi))
        for p, bit in reversed(list(enumerate(self._path(token)))):
            found = self._select(p, bit, found - self._planes[p]["zeros"] * bit)
        return found

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane's split is undone."""
        row = np.zeros(0, np.uint32)
        for p in range(len(self._planes) - 1, -1, -1):
            plane, ending = self._planes[p], self._ending[p]
            row = np.concatenate([row, np.repeat(self.symbols[ending], self._counts[ending])])
            ones = np.unpackbits(self._words[p].view(np.uint8), count=plane["n"], bitorder="little").view(bool)
            back = np.empty_like(row)
            back[~ones] = row[: plane["zeros"]]
            back[ones] = row[plane["zeros"] :]
            row = back
        return row

    def rows(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and lengths of the documents."""
        known = np.unpackbits(self._array("known", "u1"), count=self.documents)
        ids = np.cumsum(self._array("ids", "<i8"))
        return [int(d) if k else None for d, k in zip(ids, known, strict=True)], self._array("lengths", "<i8")
