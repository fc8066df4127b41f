"""Plain versions of operators, for small inputs."""

import hashlib
from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def near(docs, k):
    sets = {}
    for d, t in docs:
        w = words(t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    at = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            at[x].add(d)
    for d, s in sets.items():
        for e in {e for x in s for e in at[x] if e > d}:
            both = len(s & sets[e])
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return sorted((d, len(s), top(d), top(d) == d) for d, s in sets.items())


def repeats(docs, window):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)
