"""Quality by random indexing: word vectors pooled per document, then a two-layer network with calibrated probabilities.

A word's vector sums sparse ternary index vectors of its neighbours in the sample; an index vector of the chunk's shape
(case, digits, marks) stands beside it. A document is the mean of its vectors, of their squares, and of the
absolute differences of neighbours: what is said, how varied it is, and whether it moves on.
"""

from __future__ import annotations

import base64
import io
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .toxicity import labelled_sample

#: Labelled documents of each class that the classifier is fitted on, at most: those with the smallest xxhash64 of the id.
SAMPLE = 4000
SLOTS, WORD_DIMS, SHAPE_DIMS, HIDDEN = 1 << 15, 24, 16, 32
NEIGHBOURS = 2
THRESHOLD = 0.3
MEMORY = 200_000


def shape(chunk: str) -> str:
    """Case of the letters, 0 for digits, and the marks around them, each once: `THE!!` is A!, `anor***` is a*, `a17` is a0."""
    if chunk.isalpha():
        return _case(chunk)
    head, last = chunk[:-1], chunk[-1:]
    if head.isalpha() and not last.isdigit():
        return _case(head) + last
    return "".join(dict.fromkeys(re.sub(r"[^\W\d_]+", lambda m: _case(m[0]), re.sub(r"\d+", "0", chunk))))


def _case(letters: str) -> str:
    if letters.islower():
        return "a"
    return "A" if len(letters) > 1 and letters.isupper() else "Aa" if letters[0].isupper() else "a"


@lru_cache(10_000)
def _index_vector(name: str, dims: int, filled: int = 4) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest(name)
    v = np.zeros(dims, np.float32)
    for i in range(filled):
        v[(h >> (12 * i) & 0x7FF) % dims] += 1 if h >> (12 * i + 11) & 1 else -1
    return v


class Vectors:
    """Vectors of chunks: context vector of the word's slot, index vector of the shape."""

    def __init__(self, contexts: np.ndarray):
        self.contexts = contexts
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, WORD_DIMS + SHAPE_DIMS), np.float32)

    def rows(self, chunks: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        new = list(set(chunks).difference(known))
        if new:
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            while len(known) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[at : len(known), :WORD_DIMS] = self.contexts[[slot(c) for c in new]]
            self.table[at : len(known), WORD_DIMS:] = [_index_vector(shape(c), SHAPE_DIMS) for c in new]
        return self.table[np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))]

    def pooled(self, text: str | None) -> np.ndarray:
        chunks = (text or "").split()
        width = WORD_DIMS + SHAPE_DIMS
        if not chunks:
            return np.zeros(3 * width + 2, np.float32)
        total, squares, steps, last = np.zeros(width), np.zeros(width), np.zeros(width), None
        for at in range(0, len(chunks), 65536):
            v = self.rows(chunks[at : at + 65536])
            total += v.sum(axis=0)
            squares += np.einsum("ij,ij->j", v, v)
            steps += np.abs(np.diff(v, axis=0, prepend=v[:1] if last is None else last)).sum(axis=0)
            last = v[-1:]
        n = len(chunks)
        return np.concatenate([total / n, squares / n, steps / n, [np.log1p(n) / 8, 1.0]]).astype(np.float32)


def slot(chunk: str) -> int:
    letters = chunk if chunk.isalpha() else chunk[:-1] if chunk[:-1].isalpha() else "".join(filter(str.isalpha, chunk))
    return xxhash.xxh3_64_intdigest(letters.lower()) % SLOTS


def context_vectors(texts: list[str | None]) -> np.ndarray:
    """Per slot the normed sum of the index vectors of words up to NEIGHBOURS away."""
    index = np.random.default_rng(7).choice(np.array([-1, 0, 1], np.float32), (SLOTS, WORD_DIMS), p=[0.1, 0.8, 0.1])
    out = np.zeros((SLOTS, WORD_DIMS), np.float64)
    known: dict[str, int] = {}
    for text in texts:
        chunks = (text or "").split()
        for c in set(chunks).difference(known):
            known[c] = slot(c)
        at = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        near = np.zeros((len(at), WORD_DIMS), np.float32)
        for d in range(1, NEIGHBOURS + 1):
            near[d:] += index[at[:-d]]
            near[:-d] += index[at[d:]]
        order = np.argsort(at, kind="stable")
        if len(order):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at[order])) + 1])
            out[at[order][starts]] += np.add.reduceat(near[order], starts, axis=0)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-9)).astype(np.float32)


class Network:
    """Two layers: tanh, then a logistic output divided by the temperature."""

    def __init__(self, **parts: np.ndarray):
        self.parts = parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.parts
        return np.tanh(((x - p["mean"]) / p["scale"]) @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.parts["temperature"], -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        """Adam on four fifths of the rows; the temperature with the least log loss on the last fifth."""
        rnd = np.random.default_rng(1)
        order = rnd.permutation(len(x))
        cut = max(1, len(x) * 4 // 5)
        learn, rest = order[:cut], order[cut:] if cut < len(x) else order
        mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
        p = {"w1": rnd.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rnd.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1)}
        m, v, t = ({k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0)
        z = (x - mean) / scale
        for _ in range(rounds):
            rnd.shuffle(learn)
            for at in range(0, len(learn), 64):
                rows = learn[at : at + 64]
                h = np.tanh(z[rows] @ p["w1"] + p["b1"])
                e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(e, p["w2"]) * (1 - h * h)
                g = {"w1": z[rows].T @ back + decay * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ e + decay * p["w2"], "b2": np.array([e.sum()])}
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        net = cls(**p, mean=mean, scale=scale, temperature=np.array([1.0]))
        logits = net.logits(x[rest])

        def loss(temperature: float) -> float:
            q = 1 / (1 + np.exp(-np.clip(logits / temperature, -30, 30)))
            return float(-np.mean(y[rest] * np.log(q + 1e-9) + (1 - y[rest]) * np.log(1 - q + 1e-9)))

        net.parts["temperature"] = np.array([min(np.geomspace(0.25, 8, 60), key=loss)])
        return net


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: list[str | None] = []
    labels: list[int] = []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    if texts:
        contexts = context_vectors(texts)
        vectors = Vectors(contexts)
        net = Network.fit(np.array([vectors.pooled(t) for t in texts], np.float64), np.array(labels, float))
        file = io.BytesIO()
        np.savez_compressed(file, contexts=contexts.astype(np.float16), **net.parts)
        yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(file.getvalue()).decode()])], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """The model (numpy's npz), from labelled documents whose crc32(doc_id) mod 5 is not 0; None if there are none. The bounded sample is read by one task."""
    chosen = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, sample)
    row = chosen.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(_train, "model string").first()
    return base64.b64decode(row["model"]) if row else None


def _score(batches: Iterator[pa.RecordBatch], model: Broadcast, keep: list[str] | None) -> Iterator[pa.RecordBatch]:
    if model.value:
        parts = dict(np.load(io.BytesIO(model.value)))
        vectors = Vectors(parts.pop("contexts").astype(np.float32))
        net = Network(**parts)
    for batch in batches:
        if not batch.num_rows:
            continue
        score = net.scores(np.array([vectors.pooled(t.as_py()) for t in batch.column("text")], np.float64)) if model.value else np.ones(batch.num_rows)
        if keep is None:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])
        else:
            yield batch.filter(pa.array(score >= THRESHOLD)).select(keep)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out (its label was not used: crc32(doc_id) mod 5 is 0), score (0 to 1), predicted (score >= 0.3).

    Null and empty texts score as zero vectors. Without labelled documents, all score 1. Repeated rows score alike; a null doc_id
    isn't held out; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, model=sent, keep=None), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that score predicts 0 for; same columns, whatever their names.

    A null or empty text is judged as a zero vector, a null id like any other; repeated rows are kept or go together; without labelled
    documents all stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    return docs.mapInArrow(partial(_score, model=sent, keep=docs.columns), docs.schema)
