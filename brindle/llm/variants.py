"""Spelling variants: words that are one insertion, deletion or replacement apart, by numbered nodes of two tries.

The words, sorted, are the paths of a forward trie; reversed and sorted they are those of a reversed one. A node of the forward trie
stands for a beginning, a node of the reversed one for an ending, and each has a number. The pair (beginning before a letter,
ending after it) is what two words have in common that differ in that letter; the pair (beginning, ending) of a word cut in two without skipping
a letter is what it has in common with a longer word that has one letter between them. Equal pairs of integers are therefore exactly the neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged

#: Letters of a run. Their number bounds how many words share a pair of nodes: words that differ in one place differ by a letter there.
LETTERS = "a-zÀ-ÿ"
#: One run in so many is damaged, so that there are variants to find.
DAMAGE = 31
#: Distinct words that a task counts at once.
HELD = 200_000

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_FORWARD = pa.schema([("word", pa.string()), ("n", pa.int64()), ("rank", pa.int64()), ("nodes", pa.list_(pa.int64())), ("fresh", pa.list_(pa.bool_()))])
_REVERSED = pa.schema([("word", pa.string()), ("nodes", pa.list_(pa.int64()))])


def _count(batches: Iterator[pa.RecordBatch], least: int, damage: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]{{{least},}}")
    counts: dict[str, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run in runs.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                h = zlib.crc32(run.encode(), seed)
                if h % damage == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least:
                        continue
                counts[run] = counts.get(run, 0) + 1
            if len(counts) > HELD:
                yield from arrow_batches(counts.items(), _COUNTS)
                counts.clear()
    yield from arrow_batches(counts.items(), _COUNTS)


def word_counts(docs: DataFrame, least: int = 7, least_n: int = 2, damage: int = DAMAGE) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, one in `damage` of them short of a letter; those of `least` code points and `least_n` occurrences."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(partial(_count, least=least, damage=damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def spine(firsts: list[str]) -> list[tuple[str, list[int]]]:
    """For the first key of each part of a sorted list: the key, and for each of its beginnings the first part whose first key has it.

    A beginning that keys of two parts have is one of the later part's first key. These nodes, and just these, are numbered by the
    spine, so that all parts give them the same number.
    """
    out: list[tuple[str, list[int]]] = []
    before, owners = "", list[int]()
    for j, key in enumerate(firsts):
        k = shared(before, key)
        owners = owners[:k] + [j] * (len(key) - k)
        out.append((key, owners))
        before = key
    return out


class Trie:
    """Numbers of the nodes on the path of one key after another, of a part's sorted keys. Only the last path is held."""

    def __init__(self, part: int, spines: list[tuple[str, list[int]]]):
        self.own = spines[part]
        self.next = spines[part + 1] if part + 1 < len(spines) else ("", [])
        self.base, self.made = (part + 1) << 40, 0
        self.key, self.path = "", [0]

    def nodes(self, key: str) -> list[int]:
        k = shared(self.key, key)
        del self.path[k + 1 :]
        with_own, with_next = shared(key, self.own[0]), shared(key, self.next[0])
        for i in range(k + 1, len(key) + 1):
            if i <= max(with_own, with_next):
                owner = (self.own if i <= with_own else self.next)[1][i - 1]
                self.path.append(-((owner + 1) << 32 | i))
            else:
                self.made += 1
                self.path.append(self.base | self.made)
        self.key = key
        return list(self.path)


def _number(batches: Iterator[pa.RecordBatch], spines: list[tuple[str, list[int]]], order: dict[int, int], forward: bool) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        part, trie, row = None, None, 0
        for batch in batches:
            for at, key, n in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "n")), strict=True):
                if at != part:
                    part, trie, row = at, Trie(order[at], spines), 0
                nodes = trie.nodes(key)
                if forward:
                    yield key, n, order[at] << 40 | row, nodes, [i == 0 or key[i] != key[i - 1] for i in range(len(key))]
                else:
                    yield key[::-1], nodes
                row += 1

    yield from arrow_batches(rows(), _FORWARD if forward else _REVERSED, limit=1024)


def trie_paths(words: DataFrame, forward: bool = True) -> DataFrame:
    """For words (word, n): the numbers of the trie nodes on each word's path, root first; of the reversed words' trie if not forward.

    Words are dealt out by ranges of their order, so that a common beginning doesn't gather in one task; what parts share is
    numbered by the spine, of one key for each part. Forward also has n, the word's rank in code-point order, and fresh: for each letter,
    whether it differs from the one before.
    """
    keyed = words.select((F.col("word") if forward else F.reverse("word")).alias("key"), "n")
    parts = staged(keyed.repartitionByRange("key").select("key", "n", F.spark_partition_id().alias("part")), "trie-parts")
    firsts = sorted((r.first, r.part) for r in parts.groupBy("part").agg(F.min("key").alias("first")).collect())  # a row for each part
    order = {part: j for j, (_, part) in enumerate(firsts)}
    spines = spine([first for first, _ in firsts])
    schema = "word string, n long, rank long, nodes array<long>, fresh array<boolean>" if forward else "word string, nodes array<long>"
    return parts.repartition("part").sortWithinPartitions("part", "key").mapInArrow(partial(_number, spines=spines, order=order, forward=forward), schema)


def near_words(paths: DataFrame, reversed_paths: DataFrame) -> DataFrame:
    """rank, n_near, best (n, -rank of the near word of largest n, the smallest of those): of words that have any near word.

    A word gives a pair of nodes for each letter skipped (kind 2 where the letter isn't the same as the one before, so that a longer
    and a shorter word meet once; else 1) and for each place where a letter may be inserted (kind 0). Words that
    share a pair differ in one letter, so there are no more of them than letters, and one word without the letter.
    """
    both = paths.join(reversed_paths.select("word", F.col("nodes").alias("ends")).hint("merge"), "word").withColumn("m", F.size("fresh"))
    skipped = "transform(fresh, (new, i) -> struct(nodes[i] as p, ends[m - 1 - i] as s, if(new, 2, 1) as kind))"
    inserted = "transform(nodes, (p, i) -> struct(p, ends[m - i] as s, 0 as kind))"
    keys = both.select("rank", "n", F.explode(F.expr(f"concat({skipped}, {inserted})")).alias("k")).select("k.p", "k.s", F.struct("k.kind", "n", (-F.col("rank")).alias("rank")).alias("w"))
    met = keys.groupBy("p", "s").agg(F.collect_list("w").alias("ws")).filter("size(ws) > 1")
    others = "transform(filter(ws, y -> y.rank <> x.rank and (x.kind > 0 and y.kind > 0 or x.kind = 2 and y.kind = 0 or x.kind = 0 and y.kind = 2)), y -> struct(y.n as n, y.rank as rank))"
    each = met.select(F.explode(F.expr(f"transform(ws, x -> struct(-x.rank as rank, {others} as near))")).alias("e")).select("e.rank", "e.near").filter("size(near) > 0")
    return each.groupBy("rank").agg(F.sum(F.size("near")).cast("long").alias("n_near"), F.max(F.array_max("near")).alias("best"))


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """For words (word, n), distinct: word, form, root, n, n_near, form_n. A word's form is its near word of largest n (ties: the smallest), where that is at
    least `ratio` times the word's n; its root is the last of its forms' forms.

    Every near word counts, however many there are. A form is `ratio` times as frequent as its word, so chains are as short as the
    logarithm of the largest n, and doubling follows them in a few joins. An empty table gives no rows. Both sides of a join are
    shuffled: the size of a file says little of that of its rows in memory, and tables of words judged by it went whole to the driver and to all tasks. No form
    has many words: a word has no more near words than places times letters.
    """
    words = staged(words, "words")
    paths = staged(trie_paths(words), "forward-paths")
    near = near_words(paths, trie_paths(words, forward=False))
    known = staged(paths.select("word", "n", "rank").join(near.hint("merge"), "rank", "left"), "near-words")
    formed = (F.col("best.n") >= ratio * F.col("n")) & F.col("best").isNotNull()
    links = staged(known.filter(formed).select("rank", (-F.col("best.rank")).alias("form_rank"), (-F.col("best.rank")).alias("root_rank")), "forms")
    most, reach = words.agg(F.max("n")).first()[0] or 0, 1
    while ratio**reach <= most:
        on = links.select(F.col("rank").alias("root_rank"), F.col("root_rank").alias("further"))
        ends = links.join(on.hint("merge"), "root_rank", "left_anti")
        links = staged(links.join(on.hint("merge"), "root_rank").select("rank", "form_rank", F.col("further").alias("root_rank")).unionByName(ends.select("rank", "form_rank", "root_rank")), "forms")
        reach *= 2
    named = known.select("rank", "word", "n")
    for role in ("form", "root"):
        links = links.join(named.select(F.col("rank").alias(f"{role}_rank"), F.col("word").alias(role), F.col("n").alias(f"{role}_n")).hint("merge"), f"{role}_rank")
    out = known.join(links.hint("merge"), "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, least: int = 7, least_n: int = 2, ratio: int = 10) -> DataFrame:
    """group_variants of the words of docs (doc_id, text), counted by word_counts over all of every text.

    A null or empty text has no words; a null doc_id counts as empty text where the damage is drawn; repeated rows count again; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    return group_variants(word_counts(docs, least, least_n), ratio)
