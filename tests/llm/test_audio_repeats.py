"""Recordings with repeated passages and constant stretches."""

import numpy as np
from brindle.llm import audio


def by_all_offsets(a, b):
    """The passing offset with most hits of a run of three, over every offset with a hit."""
    best = None
    for off in range(-len(a) + 1, len(b)):
        s, t = max(0, -off), max(0, off)
        n = min(len(a) - s, len(b) - t)
        x, y = np.array(a[s : s + n]), np.array(b[t : t + n])
        hits, errors = sum((x[i : i + 3] == y[i : i + 3]).all() for i in range(n - 2)), int(np.bitwise_count(x ^ y).sum())
        if hits and n >= audio.LEAST_FRAMES and errors <= n * audio.BITS * audio.MOST_ERRORS:
            best = max(best or (0,), (int(hits), -abs(off), -off, off, n, errors))
    return best and best[3:]


def test_repeated_passages_and_stretches_align(spark):
    rnd = np.random.default_rng(7)
    a, b, d = (rnd.integers(0, 1 << 16, n).tolist() for n in (60, 40, 40))
    still = [77] * 30
    prints = [(0, a + d), (1, a + b + a + d), (10, still + b), (11, b + still * 2 + b), (12, still * 3), (20, still + [5] * 30), (21, [5, 5, 5] + still), (30, b[:2])]
    got = {(r.query_class, r["class"]): (r.offset, r.frames, r.errors) for r in audio.alignments(spark.createDataFrame(prints, "rec_id long, codes array<int>"), 10).collect()}
    want = {(q, c): m for q, x in prints if q % 10 == 0 for c, y in prints if c != q and (m := by_all_offsets(x, y))}
    assert got == want and got[0, 1] == (100, 100, 0)
