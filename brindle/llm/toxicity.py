"""Toxicity by compression distance: how much shorter do a text's windows get with a dictionary of toxic text?

Two zstandard dictionaries are trained, one on windows of ordinary documents, one on the passages that set toxic documents
apart: runs of words, or of words with their beginnings, that the toxic documents hold far more often. (Trained on all of their text, the
trainer fills a dictionary with what is frequent everywhere; the README has figures.) Each window of a text is compressed with
the ordinary dictionary alone and with the toxic one put before it: what ordinary text holds costs the same both times, so
the difference in length is what the toxic dictionary explains. How large the gains are and how many windows have them is calibrated
to a probability on labelled documents.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

WINDOW_WORDS = 8
#: Labelled documents of each class that the classifier is fitted on, at most: those with the smallest xxhash64 of the id.
SAMPLE = 4000
#: Multiples of 3: the compressor looks up every third place of a dictionary, so the ordinary text must begin at one in both.
ORDINARY_BYTES, TOXIC_BYTES = 30_000, 3_600
#: Gains in bytes that are counted, in a window.
GAINS = (1, 2, 3, 4, 5, 6)
THRESHOLD = 0.3
#: Bytes of a stem: passages of toxic documents are told apart by whole words and by stems.
STEM = 5
FOLDS = 4
#: Fixed value of the dictionary format: the three first offsets, which end the header.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
LEVEL = 3
FEATURES = 2 * len(GAINS) + 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(found: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(found[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(found), WINDOW_WORDS)]


def _distinct(texts: Iterable[str | None]) -> list[list[bytes]]:
    """Word lists of texts that aren't near copies, which would make chance words look telling: of texts with the same two smallest word
    hashes (a MinHash of two) the first goes into the dictionaries. All texts go into the calibration."""
    seen: dict[tuple, list[bytes]] = {}
    for text in texts:
        found = _words(text)
        seen.setdefault(tuple(sorted(map(xxhash.xxh3_64_intdigest, set(found)))[:2]), found)
    return list(seen.values())


def _keys(found: list[bytes]) -> set[bytes]:
    """The words, and the first bytes of longer ones."""
    distinct = set(found)
    return distinct | {w[:STEM] + b"-" for w in distinct if len(w) > STEM}


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content, of that size, of a dictionary trained on samples; where there are too few to train on, the samples.

    Of the format's parts only the content is used: contents can be put one before the other."""
    try:
        whole = zstandard.train_dictionary(size + 2048, samples).as_bytes()
        at = whole.find(_OFFSETS)
        content = whole[at + len(_OFFSETS) :] if at >= 0 else whole
    except zstandard.ZstdError:
        content = b"".join(samples)
    return content[-size:].rjust(size)


class Distance:
    """Gains of a text's windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = (self._compressor(d) for d in (ordinary, toxic + ordinary))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def gains(self, found: list[bytes]) -> np.ndarray:
        cut = windows(found)
        plain, both = self.plain.compress, self.both.compress
        return np.fromiter((len(plain(w)) - len(both(w)) for w in cut), np.int64, len(cut))

    def features(self, text: str | None) -> np.ndarray:
        gains = self.gains(_words(text))
        n = len(gains)
        counts = [float((gains >= g).sum()) for g in GAINS]
        return np.array([*np.log1p(counts), *(c / (n + 1) for c in counts), float(gains.max(initial=0)) / 4, np.log1p(n) / 4])


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def telling(bad: list[list[bytes]], good: list[list[bytes]]) -> set[bytes]:
    """Words, and stems (with a dash), that set the word lists of toxic documents apart."""
    in_bad, in_good = (Counter(k for found in docs for k in _keys(found)) for docs in (bad, good))
    # In so many of the toxic documents and in no other, not one of the keys would be found by chance.
    share = len(bad) / max(1, len(bad) + len(good))
    least = max(3, math.ceil(math.log(len(in_bad) + 2) / -math.log(min(max(share, 0.01), 0.8))), len(bad) // 100)
    return {k for k, n in in_bad.items() if n >= least and n / len(bad) >= 8 * (in_good[k] + 1) / (len(good) + 1)}


def dictionaries(texts: list[str | None], toxic: list[int]) -> dict[str, bytes]:
    """Contents of the ordinary and the toxic dictionary; all of the latter's is padding where nothing sets toxic documents apart."""
    bad, good = (_distinct(t for t, y in zip(texts, toxic, strict=True) if y == c) for c in (1, 0))
    apart = telling(bad, good)
    passages = [w for found in bad for w in found if w in apart or w[:STEM] + b"-" in apart]
    np.random.default_rng(0).shuffle(passages)
    samples = [b" " + b"  ".join(passages[i : i + 6]) + b" " for i in range(0, len(passages), 6)]
    return {"ordinary": _trained([w for found in good for w in windows(found)], ORDINARY_BYTES), "toxic": _trained(samples, TOXIC_BYTES)}


def train(texts: list[str | None], toxic: list[int]) -> dict[str, Any]:
    """The model: ordinary and toxic dictionary (hex) and the calibration's weights.

    For the calibration, each of FOLDS parts of the documents is measured with dictionaries of the other parts, since a
    document gains more from a dictionary that it went into.
    """
    weights = np.array([0.0] * FEATURES + [-5.0 if not any(toxic) else 5.0])
    if 0 < sum(toxic) < len(toxic):
        x = np.zeros((len(texts), FEATURES))
        for part in range(min(FOLDS, len(texts))):
            learn = [i for i in range(len(texts)) if i % FOLDS != part]
            other = Distance(**dictionaries([texts[i] for i in learn], [toxic[i] for i in learn]))
            x[part::FOLDS] = [other.features(t) for t in texts[part::FOLDS]]
        weights = _fit_logistic(x, np.array(toxic, float))
    return {k: v.hex() for k, v in dictionaries(texts, toxic).items()} | {"weights": weights.tolist()}


def loaded(model: str) -> tuple[Distance, np.ndarray]:
    spec = json.loads(model)
    return Distance(bytes.fromhex(spec["ordinary"]), bytes.fromhex(spec["toxic"])), np.array(spec["weights"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: list[str | None] = []
    labels: list[int] = []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(train(texts, labels))])], names=["model"])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, usable: F.Column, most: int) -> DataFrame:
    """doc_id, text, label of at most `most` documents of each class among the usable, those with the smallest hashes of their ids; of rows
    that repeat an id, the smallest text."""
    marks = labels.filter(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("label")).filter(usable)
    chosen = None
    for value in (0, 1):
        part = marks.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> str | None:
    """The model as JSON, from labelled documents whose crc32(doc_id) mod 4 is not 2; None if there are none. The bounded sample is read by one task."""
    chosen = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, sample)
    row = chosen.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(_train, "model string").first()
    return row["model"] if row else None


def _score(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    distance, weights = loaded(model.value) if model.value else (None, None)
    for batch in batches:
        if distance:
            x = np.array([distance.features(t.as_py()) for t in batch.column("text")]).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ weights, -30, 30)))
        else:
            score = np.zeros(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out (its label was not used: crc32(doc_id) mod 4 is 2), score (0 to 1), predicted (score >= 0.3).

    Null and empty texts score as a text without windows. Without labelled documents, all score 0. Repeated rows score alike; a
    null doc_id isn't held out; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, model=sent), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
