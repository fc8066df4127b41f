"""Near-duplicate detection on word shingles with HyperMinHash sketches.

A sketch has REGISTERS buckets; the leading bits of a shingle's hash choose the bucket, and the bucket keeps of its
smallest remaining hash the number of leading zeros and the next MANTISSA bits, in two bytes. Empty buckets take the
register of the first filled bucket in an order of their own, so that short texts compare register by register too.
Bands of registers give candidates; the share of equal registers, less the share that falls together by chance,
estimates the Jaccard similarity; what may reach the threshold is compared on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, dealt_join, free_name, mix64, staged
from .components import components

REGISTERS, MANTISSA, BANDS, BAND_ROWS = 256, 10, 42, 6
#: Chance that two different hashes, of equally frequent buckets, share a register: the mean relative width of a register's cell.
CELL = 2.0**-MANTISSA * float(np.log(2))
#: A band's bucket of at most this many members is compared pair by pair at once.
SMALL = 6
#: Candidates whose estimate is lower than the threshold by this many standard errors are dropped.
SLACK = 5.0
#: Members of a bucket, and bytes of their sets, that a task holds at once, about; larger buckets are dealt out in blocks.
BLOCK, BLOCK_BYTES = 1024, 16 << 20

_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)
_ORDER = np.array([np.random.default_rng(b).permutation(REGISTERS) for b in range(REGISTERS)])
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the one of the whole sequence; of none, none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    mixed = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j])
    return np.unique(mixed)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty: uint16 for each bucket."""
    at = np.searchsorted(shingles, _EDGES)
    first = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & (first >> np.uint64(56) == np.arange(REGISTERS, dtype=np.uint64))
    rest = np.maximum(first & np.uint64((1 << 56) - 1), np.uint64(1))
    length = np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    over = rest >> np.minimum(length, np.uint64(63)) != 0  # rounded up to the next power of two
    length = np.where(over, length + np.uint64(1), length)
    length = np.where(rest >> (length - np.uint64(1)) == 0, length - np.uint64(1), length)
    zeros = np.uint64(56) - length
    shifted = (rest << (zeros + np.uint64(1))) & np.uint64((1 << 56) - 1)
    out = (zeros << np.uint64(MANTISSA) | shifted >> np.uint64(56 - MANTISSA)).astype(np.uint16)
    if not filled.all():
        have = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        out[empty] = out[have[_RANK[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from numbers of equal registers, corrected for registers that are equal by chance."""
    chance = CELL * n_a * n_b / (n_a + n_b) ** 2
    return (equal / REGISTERS - chance) / (1 - chance)


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, names, sketches = [], [], []
        for text in batch.column("text"):
            found = shingle_set(hashes((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()), k)
            sizes.append(len(found))
            names.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            sketches.append(registers(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "name", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [shingle_set(hashes((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()), k).tobytes() for t in batch.column("text")]
        kept = [batch.column(c) for c in ("doc_id", "n_shingles", "sketch")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], names=["node", "n_shingles", "sketch", "shingles"])


def _least(sizes: np.ndarray, least: float) -> np.ndarray:
    """Estimates that a pair at the threshold doesn't fall below; a sketch samples no more than there are shingles."""
    return least - SLACK * np.sqrt(least * (1 - least) / np.minimum(REGISTERS, sizes))


def _linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return den * both >= num * (len(s) + len(t) - both)


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
        n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        keep = estimate((a == b).sum(axis=1), n_a.astype(float), n_b.astype(float)) >= _least(np.minimum(n_a, n_b), least)
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _settle(group: pa.Table, num: int, den: int) -> pa.Table:
    """Links that join components: of a block of a bucket's strays (the rows that ask) with a block of its members.

    Members of other components are estimated, a stray at a time; those that may be linked are compared on their full
    sets, the likeliest first, unless links found before have joined them. A pair that shares an earlier band is left to that,
    one of two strays to the smaller.
    """
    asks = group.column("asks").to_numpy(zero_copy_only=False)
    nodes, labels, sizes, strays = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n_shingles", "stray"))
    band = group.column("band")[0].as_py()
    sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    banded = sketches[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)[:, :band]
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in group.column("shingles").chunks for x in c]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    pairs: list[tuple[float, int, int]] = []
    for x in np.flatnonzero(asks).tolist():
        small, large = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        ys = np.flatnonzero(~asks & (labels != labels[x]) & (~strays | (nodes > nodes[x])) & (den * small >= num * large))
        if not len(ys):
            continue
        equal = (sketches[ys] == sketches[x]).sum(axis=1)
        guess = estimate(equal, np.full(len(ys), float(sizes[x])), sizes[ys].astype(float))
        near = guess >= _least(small[ys], num / den)
        ys, guess = ys[near], guess[near]
        if band and len(ys):
            fresh = ~(banded[ys] == banded[x]).all(axis=2).any(axis=1)
            ys, guess = ys[fresh], guess[fresh]
        pairs += zip((-guess).tolist(), [x] * len(ys), ys.tolist(), strict=True)
    found: list[tuple[int, int]] = []
    for _, x, y in sorted(pairs):
        p, q = top(int(labels[x])), top(int(labels[y]))
        if p != q and _linked(sets[x], sets[y], num, den):
            up[max(p, q)] = min(p, q)
            found.append((int(nodes[x]), int(nodes[y])))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(pairs: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are linked."""
    size = f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)"  # else the threshold is out of reach
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    likely = pairs.filter(size).mapInArrow(partial(_likely, least=num / den), "a long, b long")
    for side in ("a", "b"):
        likely = likely.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    return likely.select("a", "b", "set_a", "set_b").mapInArrow(partial(_confirmed, num=num, den=den), "a long, b long")


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is its own).

    Two documents are linked if the sets of k-word shingles (lower-cased A-Z) have den * intersection >= num * union. Texts with
    equal sets are one node from the start. In a band's bucket the smallest node is compared with all others; where that leaves
    nodes of different components, those are compared with each other, so no pair that shares a bucket goes unchecked unless it
    is connected already. Two texts at the threshold share none of the bands with a chance of 3 in a million.

    A null or empty text, or one without words, has n_shingles 0 and is linked with nothing. Rows without doc_id have
    component_id null, are kept and link nothing. Rows that repeat a doc_id are one document, linked over any of its texts. Other
    columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = staged(docs.mapInArrow(partial(_sketches, k=k), "doc_id long, n_shingles long, name binary, sketch binary"), "sketches")
    known = sketches.filter("name is not null and doc_id is not null")
    classes = staged(known.groupBy("name").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    width = 2 * BAND_ROWS
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(BANDS)))
    bands = classes.select("node", "n_shingles", F.posexplode(keys).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first")).filter("members > 1")
    members = staged(dealt_join(bands, buckets, "key", "node").select("key", "band", "node", "n_shingles", "members", "first"), "members")
    stars = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    small = members.filter(f"members > 2 and members <= {SMALL}").groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("all"))
    rest = small.select(F.explode(F.expr("flatten(transform(all, (x, i) -> transform(slice(all, i + 2, size(all)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    involved = classes.join(members.select("node").distinct(), "node").select(F.col("node").alias("doc_id"), "n_shingles", "sketch")
    sets = staged(docs.join(involved, "doc_id").mapInArrow(partial(_sets, k=k), "node long, n_shingles long, sketch binary, shingles binary"), "sets")
    links = staged(_verify(stars.union(rest).distinct(), classes, sets, num, den), "confirmed")
    found = staged(components(links), "components")
    more = _unsettled(members.filter(f"members > {SMALL}"), found, sets, num, den)
    found = staged(components(links.union(more)), "components")
    per_class = classes.select("name", "node").join(found, "node", "left").select("name", F.coalesce("component", "node").alias("component"))
    unnamed = sketches.filter("name is null").withColumn("component", F.lit(None).cast("long"))  # linked with nothing: kept out of the join
    out = sketches.filter("name is not null").join(per_class, "name", "left").unionByName(unnamed)
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _unsettled(members: DataFrame, found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between members of a bucket that are in different components so far.

    Strays, the members that aren't of the bucket's largest component, are compared with all its members of other components, in blocks
    of both: each member moves once for each block of strays, each stray once for each block of members. Buckets of one
    component don't move. Pairs are compared where the rows meet, and only links leave the task.
    """
    labelled = members.join(found, "node", "left").select("key", "band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    each = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    order = F.struct("n", "component")
    n, size, most, most_size = F.sum("n"), F.sum("size"), F.max("n"), F.max_by("size", order)
    in_blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size * 8 / BLOCK_BYTES))
    open_ = each.groupBy("key").agg(F.count("*").alias("components"), F.max_by("component", order).alias("largest"), in_blocks(n, size).alias("blocks"), in_blocks(n - most, size - most_size).alias("stray_blocks"))
    open_ = staged(open_.filter("components > 1").drop("components"), "open-buckets")  # a table of its own, so that the join with it can be split
    here = staged(labelled.join(open_, "key").withColumn("stray", F.col("component") != F.col("largest")), "unsettled")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    asking = here.filter("stray").select("*", block("stray_blocks").alias("i"), every("blocks").alias("j"), F.lit(True).alias("asks"))
    asked = here.select("*", every("stray_blocks").alias("i"), block("blocks").alias("j"), F.lit(False).alias("asks"))
    rows = asking.unionByName(asked).drop("n_shingles").join(sets, "node").select("key", "i", "j", "asks", "stray", "band", "node", "component", "n_shingles", "sketch", "shingles")

    def settle(group: pa.Table) -> pa.Table:
        return _settle(group, num, den)

    return rows.groupBy("key", "i", "j").applyInArrow(settle, "a long, b long")


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the documents that near_components doesn't keep; same columns, whatever their names.

    Texts without words are linked with nothing and stay. Rows without doc_id stay. Rows that repeat a doc_id are one document and stay or go
    together. An empty table gives no rows.
    """
    own = free_name(docs, "kept_id")
    keep = near_components(docs, k, num, den).filter("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(keep, F.col("doc_id") == F.col(own), "left_semi").union(docs.filter("doc_id is null"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] ELSE ws END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
ee AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, ee.v FROM r JOIN ee ON ee.u = r.v),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.u = w.doc_id
"""
