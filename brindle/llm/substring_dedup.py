"""Removal of word passages that an earlier document holds, by suffix automata of reference shards.

All pairs of a document and a shard would be the square of the corpus, and an automaton of the whole corpus has no size
that could be broadcast. So text and automata are first brought together by anchors: of each window of words the
smallest hash of a GRAM of words (its minimizer). Equal windows have equal anchors, so a window can only recur among the
windows with its anchor. The windows of a document that follow one another with the same anchor are a segment;
segments of equal words are one class. The classes of an anchor are a reference of its own, many anchors make a shard, and
a shard's automaton is built in the task that streams the shard's classes through it. An anchor of more classes than a
shard should hold (a line that many documents share) is taken apart as a Grace hash join takes a bucket apart: its classes
are cut anew at longer anchors, parts of equal words become one, parts of one document alone go, and what is still too
large is cut at longer ones yet, at last window by window, where a class is a window and an anchor has one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, arrow_batches, dealt_join, mix64, staged, words
from .suffix_automaton import SuffixAutomaton

WINDOW, GRAM = 50, 10
#: Words by which the anchors of a level are longer than those of the one before.
LONGER = 15
#: Positions that fit beside a hash in 64 bits; longer texts are cut for the search of anchors, with WINDOW - 1 words of overlap.
PLACE_BITS = 20
#: Words of a shard, about: it is closed at the end of an anchor.
SHARD_WORDS = 20_000
#: Anchors of more classes are cut at longer anchors.
MOST_CLASSES = 500

_A = np.uint64(0x9E3779B97F4A7C15)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all n consecutive items, by doubling."""
    out, done, power, at = None, 0, h, 1
    while True:
        if n & at:
            if out is None:
                out, done = power, at
            else:  # out covers the last done items, power the at before them
                size = len(h) - (done + at) + 1
                out = power[:size] * _power(done) + out[at : at + size]
                done += at
        at *= 2
        if at > n:
            return mix64(out)
        power = power[: len(power) - at // 2] * _power(at // 2) + power[at // 2 :]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the word hashes of a text: per segment its anchor, its class (a hash of its words), start and number of windows."""
    parts: list[tuple[np.ndarray, ...]] = []
    most = (1 << PLACE_BITS) - window
    for at in range(0, max(0, len(h) - window + 1), most):
        part = h[at : at + most + window - 1]
        grams, windows = _rolled(part, gram), _rolled(part, window)
        low = (grams << np.uint64(PLACE_BITS) >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        span, width = window - gram + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        counts = np.diff(starts, append=len(low))
        anchors = grams[(low[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)]
        # A segment has fewer windows than a window has words, so its first and last windows hold all its words.
        names = mix64(windows[starts] * _A + mix64(windows[starts + counts - 1] + counts.astype(np.uint64)))
        parts.append((anchors, names, starts + at, counts))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hashes_of(text: pa.Scalar, hashes: WordHashes) -> np.ndarray:
    raw = text.as_py()
    return hashes(raw.encode("utf-8", "surrogatepass").split() if raw else [])


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [segments(_hashes_of(t, hashes), window, gram) for t in batch.column("text")]
        sizes = [len(f[0]) for f in found]
        anchor, name, start, count = (np.concatenate(x) if found else np.zeros(0) for x in zip(*found, strict=True))
        doc, sub = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc_id", "sub"))
        columns = [anchor.view(np.int64), name.view(np.int64), doc, sub, start.astype(np.int32), count.astype(np.int16)]
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "class", "doc_id", "sub", "start", "n"])
        for at in range(0, whole.num_rows, 65536):
            yield whole.slice(at, 65536)


_WORDS = pa.schema([("anchor", pa.int64()), ("class", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.binary())])


def _class_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for packed, doc_id, wanted in zip(batch.column("packed"), batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                h = hashes(unpack.decompress(packed.as_py()).split())
                for w in wanted:
                    yield w["anchor"], w["class"], doc_id, w["last"], h[w["start"] : w["start"] + w["n"] + window - 1].tobytes()

    yield from arrow_batches(rows(), _WORDS)


_CUT = pa.schema([*_WORDS, ("whole_anchor", pa.int64()), ("whole_class", pa.int64()), ("at", pa.int32())])


def _cut_classes(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Classes cut at anchors of that many words."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for anchor, name, first, last, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "class", "first", "last", "words")), strict=True):
                h = np.frombuffer(raw, np.uint64)
                anchors, names, starts, counts = segments(h, window, gram)
                anchors = mix64(anchors + np.uint64(anchor & (1 << 64) - 1)).view(np.int64)
                for a, c, s, n in zip(anchors.tolist(), names.view(np.int64).tolist(), starts.tolist(), counts.tolist(), strict=True):
                    yield a, c, first, last, raw[8 * s : 8 * (s + n + window - 1)], anchor, name, s

    yield from arrow_batches(rows(), _CUT)


_RUNS = pa.schema([("anchor", pa.int64()), ("class", pa.int64()), ("runs", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("first", pa.int64())])))])


def _match(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per class: runs of its windows with the same first document."""

    def shard(held: list[tuple]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        for _, _, first, words in held:
            automaton.add(words, first)
        automaton.close()
        for anchor, name, _, words in held:
            runs: list[dict] = []
            for at, first in enumerate(automaton.firsts(words, window)):
                if runs and runs[-1]["first"] == first:
                    runs[-1]["n"] += 1
                else:
                    runs.append({"at": at, "n": 1, "first": first})
            yield anchor, name, runs

    def rows() -> Iterator[tuple]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for anchor, name, first, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "class", "first", "words")), strict=True):
                if size >= SHARD_WORDS and anchor != last:
                    yield from shard(held)
                    held, size = [], 0
                found = np.frombuffer(words, np.uint64).tolist()
                held.append((anchor, name, first, found))
                size, last = size + len(found), anchor
        yield from shard(held)

    yield from arrow_batches(rows(), _RUNS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [pack.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sub"), pa.array(packed, pa.binary())], names=["doc_id", "sub", "packed"])


def _cut(words: list[bytes], spans: list[dict] | None, window: int) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        edge[s["at"]] += 1
        edge[s["at"] + s["n"] + window - 1] -= 1
    return [w for w, covered in zip(words, np.cumsum(edge[:-1]), strict=True) if not covered]


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _remove(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for packed, doc_id, spans in zip(batch.column("packed"), batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                found = unpack.decompress(packed.as_py()).split()
                left = _cut(found, spans, window)
                text = b" ".join(left)
                yield doc_id, len(found), len(found) - len(left), hashlib.sha256(text).hexdigest().encode() if digest else text

    yield from arrow_batches(rows(), _KEPT)


def _of_shared(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """The rows whose anchor is met in two documents or more, their ids being lo to hi."""
    shared = rows.groupBy("anchor").agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi")).filter("_lo < _hi").select("anchor")
    return dealt_join(rows, shared, "anchor", "class")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document with such windows: doc_id, sub (crc32 of the text), spans (array of at, n): windows at .. at + n - 1 also
    start in a document with a smaller doc_id."""
    docs = _keyed(docs).filter("doc_id is not null")
    anchors = staged(docs.mapInArrow(partial(_anchors, window=window, gram=gram), "anchor long, class long, doc_id long, sub int, start int, n short"), "anchors")
    here = staged(_of_shared(anchors, "doc_id", "doc_id"), "shared-anchors")
    classes = here.groupBy("anchor", "class").agg(F.min(F.struct("doc_id", "sub", "start", "n")).alias("f"), F.max("doc_id").alias("last"))
    wanted = classes.groupBy("f.doc_id", "f.sub").agg(F.collect_list(F.struct("anchor", "class", "last", F.col("f.start").alias("start"), F.col("f.n").alias("n"))).alias("wanted"))
    packed = docs.mapInArrow(_pack, "doc_id long, sub int, packed binary")
    texts = packed.join(wanted, ["doc_id", "sub"]).select("doc_id", "packed", "wanted")
    level = staged(texts.mapInArrow(partial(_class_words, window=window), "anchor long, class long, first long, last long, words binary"), "classes")

    settled: list[DataFrame] = []
    cuts: list[DataFrame] = []
    while gram < window:
        gram = min(gram + LONGER, window)
        hot = staged(level.groupBy("anchor").count().filter(F.col("count") > MOST_CLASSES).select("anchor"), "hot-anchors")
        if hot.isEmpty():
            break
        settled.append(level.join(hot, "anchor", "left_anti"))
        cut = level.join(hot, "anchor", "left_semi").mapInArrow(partial(_cut_classes, window=window, gram=gram), "anchor long, class long, first long, last long, words binary, whole_anchor long, whole_class long, at int")
        cuts.append(staged(cut, "cut-classes"))
        parts = cuts[-1].groupBy("anchor", "class").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("words").alias("words"))
        level = staged(_of_shared(parts, "first", "last").select("anchor", "class", "first", "last", "words"), "classes")
    references = reduce(DataFrame.union, settled, level).select("anchor", "class", "first", "words")
    runs = references.repartition("anchor").sortWithinPartitions("anchor", "first").mapInArrow(partial(_match, window=window), "anchor long, class long, runs array<struct<at:int,n:int,first:long>>")
    known = found = staged(runs.select("anchor", "class", F.inline("runs")), "runs")
    for cut in reversed(cuts):
        whole = cut.select("anchor", "class", "whole_anchor", "whole_class", F.col("at").alias("_at")).join(known, ["anchor", "class"])
        known = found.union(whole.select("whole_anchor", "whole_class", F.col("_at") + F.col("at"), "n", "first"))
    spans = here.select("anchor", "class", "doc_id", "sub", "start").join(known, ["anchor", "class"]).filter("first < doc_id")
    return spans.groupBy("doc_id", "sub").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("at"), "n")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - F.lit(1 << 31)).cast("int").alias("sub"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a space; their sha256 in hex if digest).

    A word goes if a window of that many words that covers it also starts in a document with a smaller doc_id. A null or
    empty text has no words. Rows that repeat a doc_id are of one document: none is earlier than the other, each
    keeps its own text. A row without doc_id loses nothing and is nobody's earlier document. Other columns are ignored. An
    empty table gives no rows.
    """
    spans = repeated_spans(docs, window)
    packed = _keyed(docs).mapInArrow(_pack, "doc_id long, sub int, packed binary")
    joined = packed.join(spans, ["doc_id", "sub"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(partial(_remove, window=window, digest=digest), "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def removal_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


#: Words of a reference that is broadcast, at most: its automaton takes some 400 bytes a word in each worker.
BROADCAST_WORDS = 100_000


def _stream(batches: Iterator[pa.RecordBatch], reference: Broadcast, window: int) -> Iterator[pa.RecordBatch]:
    hashes, automaton = WordHashes(), SuffixAutomaton()
    for text in reference.value:
        automaton.add(hashes(words(text)).tolist(), 0)
    automaton.close()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = words(text.as_py())
                spans = [{"at": at, "n": 1} for at, first in enumerate(automaton.firsts(hashes(found).tolist(), window)) if first == 0]
                left = _cut(found, spans, window)
                yield doc_id, len(found), len(found) - len(left), b" ".join(left)

    yield from arrow_batches(rows(), _KEPT)


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """remove_repeats against a table of its own (reference: text), say a benchmark: words in a window that a reference text holds go.

    The reference's automaton is broadcast, so its size is counted first; beyond BROADCAST_WORDS it is an error: put the texts before the
    documents, with smaller ids, and use remove_repeats. Null and empty texts hold nothing. Documents don't see each other; repeated rows and null
    ids stay as they are; an empty reference removes nothing; an empty table gives no rows.
    """
    size = reference.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0)).alias("n")).first()["n"]
    if size > BROADCAST_WORDS:
        raise ValueError(f"a reference of {size} words is too large to broadcast")
    texts = [r["text"] for r in reference.filter("text is not null").select("text").distinct().collect()]
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_stream, reference=sent, window=window), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY sha256(array_to_string(ws[i : i + 49], ' '))) AS first FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f WHERE first < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
