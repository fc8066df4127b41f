import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from brindle.llm import mixing, quality

sys.path.insert(0, str(Path(__file__).parent))
import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {0: docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.createDataFrame(rows[i], docs.schema), SF)
        rows[i + 1] = out.collect()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in rows[1]} == good
    last = {}
    for r in rows[1]:
        key = r.text.encode().lower()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(last.values())
    assert sorted(r.doc_id for r in rows[3]) == [d for d, _, _, kept in brute.near([(r.doc_id, r.text) for r in rows[2]], 5) if kept]
    taken = {r.doc_id: r.taken for r in mixing.mix_taken(spark.createDataFrame(rows[3], docs.schema)).collect() if r.taken}
    mixed, texts = Counter(), {r.doc_id: brute.words(r.text) for r in rows[3]}
    for r in rows[4]:
        mixed[r.doc_id] += len(brute.words(r.text))
        assert texts[r.doc_id][: len(brute.words(r.text))] == brute.words(r.text)
    assert dict(mixed) == taken and max(Counter(r.doc_id for r in rows[4]).values()) <= 3
    assert len(rows[5]) == len(rows[4])


def test_run_gives_the_stages_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 10


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, ties, a long text, a column that clashes; then nothing at all."""
    fields = "doc_id long, text string, lang string, source string, n_chars long, score double"
    body = "The quick brown fox jumps over the lazy dog near the old river bank today."
    rows = [
        (1, body, "en", "a", 1, 0.5), (1, body, "en", "a", 1, 0.5), (2, body.upper(), "en", None, 2, None), (None, body, "en", "a", 3, 0.1), (None, None, None, None, None, None), (3, "", "en", "b", 0, 0.0),
        (4, "long words go on " * 20_000, "en", "b", 9, 1.0), (5, body + " And then it rests.", "en", "b", 4, 0.2),
    ]
    docs = spark.createDataFrame(rows, fields)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() <= 3 * len(rows), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()) == [2, 3, 4, 5]
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_columns_of_any_name(spark):
    """Names that stages might use within; values stay with their rows."""
    extra = ["_id", "_bucket", "bucket", "kept_id", "_size", "_n", "_i", "_k", "_row", "_words", "row"]
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in extra)
    rows = [(i, f"word number {i} stands here alone in the text of document {i * i} for once", "en", "ab"[i % 2], i, *(100 * i + j for j in range(len(extra)))) for i in range(12)]
    docs = spark.createDataFrame([*rows, (99, rows[3][1], "en", "a", 3, *rows[3][5:])], fields)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for stage in (lambda d: quality.keep_good(d, labels), *(lambda d, f=f: f(spark, d, SF) for _, f in corpus_pipeline.STAGES[1:4])):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert list(r[5:]) == [100 * r.n_chars + j for j in range(len(extra))]
