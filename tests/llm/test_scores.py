import zlib

import numpy as np
from brindle.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def crc(d):
    return zlib.crc32(str(d).encode())


def check(rows, labels, folds, rest, recall, clean):
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % folds == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p for p, y in held if y]) >= recall
    assert np.mean([1 - p for p, y in held if not y]) >= clean


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.quality for r in labels.collect()}, 5, 0, 0.95, 0.8)
    assert [r.score for r in sorted(rows)] == [r.score for r in sorted(quality.score(docs, labels).collect())]
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.toxic for r in labels.collect()}, 4, 2, 0.75, 0.95)


def test_scores_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "fine words here", "c"), (3, "fine words here", "c"), (None, "no id", "d"), (7, "long " * 50000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for op in (quality.score, toxicity.score):
        assert sorted(str(r.doc_id) for r in op(docs, marks).collect()) == sorted(str(r[0]) for r in rows)
        assert op(docs, marks.limit(0)).count() == 6
        assert op(docs.limit(0), marks).count() == 0


def test_shapes():
    assert [quality.shape(c) for c in ("THE!!", "anor***", "Word", "a1", "x")] == ["A!", "a*", "Aa", "a0", "a"]


def test_gains_only_where_toxic_text_is():
    d = toxicity.Distance(b"the of and that with from " * 20, b" worthless  pathetic  disgusting ")
    found = b"the of and that with from the of".split()
    assert d.gains(found).tolist() == [0]
    assert d.gains([*found[:4], b"disgusting", *found[:3]]).max() > 2
