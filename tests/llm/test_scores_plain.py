"""Scores of the two classifiers against plain versions."""

import json
import math

import numpy as np
import xxhash
import zstandard
from brindle.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def plain_vector(text, contexts):
    """Pooled vector, word by word."""
    chunks = (text or "").split()
    width = quality.WORD_DIMS + quality.SHAPE_DIMS
    if not chunks:
        return [0.0] * (3 * width + 2)
    rows = []
    for c in chunks:
        letters = c if c.isalpha() else c[:-1] if c[:-1].isalpha() else "".join(x for x in c if x.isalpha())
        h = xxhash.xxh3_64_intdigest(quality.shape(c))
        shape = [0.0] * quality.SHAPE_DIMS
        for i in range(4):
            shape[(h >> (12 * i) & 0x7FF) % quality.SHAPE_DIMS] += 1 if h >> (12 * i + 11) & 1 else -1
        rows.append([*map(float, contexts[xxhash.xxh3_64_intdigest(letters.lower()) % quality.SLOTS]), *shape])
    n = len(rows)
    mean = [sum(r[j] for r in rows) / n for j in range(width)]
    squares = [sum(r[j] ** 2 for r in rows) / n for j in range(width)]
    steps = [sum(abs(b[j] - a[j]) for a, b in zip(rows, rows[1:], strict=False)) / n for j in range(width)]
    return [*mean, *squares, *steps, math.log1p(n) / 8, 1.0]


def test_quality_scores_are_the_plain_networks(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    import io

    parts = dict(np.load(io.BytesIO(quality.fit(docs, labels))))
    contexts, w1, w2 = parts["contexts"], parts["w1"], parts["w2"]
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    rows = docs.orderBy("doc_id").limit(60).collect() + docs.filter("text is null or length(text) < 20").limit(10).collect()
    for r in rows:
        x = [(v - m) / s for v, m, s in zip(plain_vector(r.text, contexts), parts["mean"], parts["scale"], strict=True)]
        hidden = [math.tanh(sum(a * b for a, b in zip(x, w1[:, j], strict=True)) + parts["b1"][j]) for j in range(quality.HIDDEN)]
        logit = (sum(a * b for a, b in zip(hidden, w2, strict=True)) + parts["b2"][0]) / float(parts["temperature"][0])
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, logit))))) < 2e-3


def test_toxicity_scores_are_the_plain_distances(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = json.loads(toxicity.fit(docs, labels))
    ordinary, toxic = bytes.fromhex(model["ordinary"]), bytes.fromhex(model["toxic"])
    assert (len(ordinary), len(toxic)) == (toxicity.ORDINARY_BYTES, toxicity.TOXIC_BYTES)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}

    def size(window, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for r in docs.orderBy("doc_id").limit(25).collect() + docs.filter("text is null or length(text) < 20").limit(10).collect():
        words = (r.text or "").encode().lower().split()
        cut = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
        gains = [size(w, ordinary) - size(w, toxic + ordinary) for w in cut]
        counts = [sum(g >= least for g in gains) for least in (1, 2, 3, 4, 5, 6)]
        x = [*(math.log1p(c) for c in counts), *(c / (len(gains) + 1) for c in counts), max([0, *gains]) / 4, math.log1p(len(gains)) / 4, 1.0]
        logit = sum(a * b for a, b in zip(x, model["weights"], strict=True))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, logit))))) < 1e-6
