import random
import sys
from pathlib import Path

import numpy as np
import pytest
from brindle.llm import exact_dedup, near_dedup, substring_dedup
from brindle.llm.components import components
from brindle.llm.exact_dedup import GraceTable, Group
from brindle.llm.suffix_automaton import NO_DOCUMENT, SuffixAutomaton

sys.path.insert(0, str(Path(__file__).parent))
import brute

SF = "/root/testdata/sf0.001"


def texts(spark, where=SF):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]


def family(n=60, size=120, edits=6, seed=0):
    """Near copies of one text, copies of copies, short texts and odd ones."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(60)}" for _ in range(size)]
    docs = []
    for d in range(n):
        w = list(base if d % 3 else docs[-1][1].split() if docs else base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
        docs.append((d, " ".join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "One  two"), (1007, " ".join(base * 300))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_components_match_brute_force(spark, k):
    for docs in (family(), family(90, 40, 5, 1), texts(spark)):
        got = near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string"), k)
        assert sorted(map(tuple, got.collect())) == brute.near(docs, k)


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (5, "a b c d e f", "z"), (7, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    got = sorted(map(tuple, near_dedup.near_components(docs).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (7, 0, 7, True)], key=repr)
    assert near_dedup.near_components(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_copies(docs).collect()) == [0, 3, 3, 7]


def test_estimate_is_near_the_truth():
    rnd = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        both = rnd.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, 4000 - len(both), dtype=np.uint64) * np.uint64(2)])) for _ in "ab")
        true = len(both) / (len(a) + len(b) - len(both))
        guess = near_dedup.estimate(np.array([(near_dedup.registers(a) == near_dedup.registers(b)).sum()]), np.array([4000.0]), np.array([4000.0]))[0]
        assert abs(guess - true) < 0.12


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 7), (50, 50)] + [(1, 200 + i) for i in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, 7: 5, 9: 5, 1: 1, **{200 + i: 1 for i in range(50)}}


def grace_groups(records, budget):
    table, joined = GraceTable(budget), []
    for r in records:
        if (g := table.push(r)) is not None:
            joined.append((g.tag, r.tag))
    groups = []
    for g, r in table.finish():
        if r is None:
            groups.append(g)
        else:
            joined.append((g.tag, r.tag))
    return groups, joined


def test_grace_table_spills_and_finds_all_groups():
    import hashlib

    rnd = random.Random(1)
    contents = [bytes([rnd.randrange(256)]) * 300 for _ in range(3000)]
    groups, joined = grace_groups((Group(hashlib.sha256(c).digest(), c, i, 1, None, i) for i, c in enumerate(contents)), 20_000)
    assert sorted(g.content for g in groups) == sorted(set(contents))
    assert all(g.best == max(i for i, c in enumerate(contents) if c == g.content) and g.rows == contents.count(g.content) and g.tag == contents.index(g.content) for g in groups)
    assert sorted([t for _, t in joined] + [g.tag for g in groups]) == list(range(3000)) and all(contents[a] == contents[b] for a, b in joined)
    clash = (Group(b"d" * 32, bytes([c]), i, 1, None, i) for i, c in enumerate(b"abcabca"))  # equal digests, other contents
    assert sorted((g.content, g.rows) for g in grace_groups(clash, 100)[0]) == [(b"a", 3), (b"b", 2), (b"c", 2)]


def test_exact_dedup_odd_rows(spark):
    rows = [(1, None, "x"), (4, "", "y"), (2, "Äb C", "a"), (9, "Äb c", "b"), (9, "Äb c", "b"), (3, "äb c", "c"), (None, "zz", "d"), (None, "ZZ", "e"), (8, "long " * 90000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    got = sorted([tuple(r)[:4] for r in exact_dedup.mark_copies(docs).collect()], key=repr)
    want = [(1, 4, 2, False), (4, 4, 2, True), (2, 9, 3, False), (9, 9, 3, True), (9, 9, 3, True), (3, 3, 1, True), (None, None, 2, True), (None, None, 2, True), (8, 8, 1, True)]
    assert got == sorted(want, key=repr)
    left = exact_dedup.drop_copies(docs)
    assert left.schema == docs.schema
    assert sorted((r.doc_id or 0, r.digest) for r in left.collect() if r.doc_id) == [(3, "c"), (4, "y"), (8, "f"), (9, "b")]
    assert left.count() == 5
    assert exact_dedup.mark_copies(docs.limit(0)).count() == 0


def test_automaton_knows_first_documents():
    rnd = random.Random(2)
    docs = [(d, [rnd.randrange(3) for _ in range(rnd.randrange(5, 60))]) for d in (4, 4, 7, 9, 1, 30)]
    a = SuffixAutomaton()
    for d, w in docs:
        a.add(w, d)
    a.close()
    for n in (1, 3, 5, 8):
        probe = [rnd.randrange(4) for _ in range(200)] + docs[2][1]
        want = [min([d for d, w in docs if any(w[j : j + n] == probe[i : i + n] for j in range(len(w)))], default=NO_DOCUMENT) for i in range(len(probe) - n + 1)]
        assert a.firsts(probe, n) == want


def passages(seed=0):
    rnd = random.Random(seed)
    shared = [[f"p{s}_{i}" for i in range(rnd.choice([12, 20, 35, 60]))] for s in range(6)]
    docs = []
    for d in range(120):
        w = []
        for _ in range(rnd.randrange(1, 6)):
            w += [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 25))]
            if rnd.random() < 0.6:
                p = rnd.choice(shared)
                w += p[rnd.randrange(4) : len(p) - rnd.randrange(4)]
        docs.append((d * 7 % 121, " ".join(w)))
    return docs + [(500, docs[3][1]), (501, docs[3][1] + " more"), (502, None), (503, ""), (504, "r " * 400), (505, "r " * 300)]


@pytest.mark.parametrize("most", [1000, 3, 1])
def test_removed_passages_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_CLASSES", most)
    for docs, window in ((passages(), 15), (passages(1), 50), (texts(spark), 50)):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = substring_dedup.remove_repeats(frame, window, digest=True)
        assert sorted(map(tuple, got.collect())) == brute.repeats(docs, window)


def test_segments_of_texts_longer_than_a_place(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PLACE_BITS", 7)
    h = np.random.default_rng(0).integers(0, 1 << 62, 1000, dtype=np.uint64)
    _, _, start, n = substring_dedup.segments(h)
    assert [i for s, c in zip(start, n, strict=True) for i in range(s, s + c)] == list(range(951))


def test_removal_odd_rows(spark):
    body = " ".join(f"w{i}" for i in range(80))
    rows = [(2, body, "x"), (2, body, "x"), (2, "other", "y"), (None, body, "z"), (1, None, "n"), (6, body, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted([tuple(r)[:3] for r in substring_dedup.remove_repeats(docs).collect()], key=repr)
    assert got == sorted([(2, 80, 0), (2, 80, 0), (2, 1, 0), (None, 80, 0), (1, 0, 0), (6, 80, 80)], key=repr)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 40])
def test_large_buckets_are_settled_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    for docs in (family(150, 90, 9, 3), family(120, 60, 14, 4)):
        got = near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string"), 2)
        assert sorted(map(tuple, got.collect())) == brute.near(docs, 2)


def test_removal_against_a_reference(spark, monkeypatch):
    for seed, window in ((0, 15), (1, 50)):
        docs = [(d, t) for d, t in passages(seed)]
        known = [t for d, t in docs if d % 7 == 3] + [None, ""]
        first = {tuple(brute.words(t)[i : i + window]) for t in known for i in range(len(brute.words(t)) - window + 1)}
        want = []
        for d, t in docs:
            w = brute.words(t)
            gone = {j for i in range(len(w) - window + 1) if tuple(w[i : i + window]) in first for j in range(i, i + window)}
            want.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
        frame, reference = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in known], "text string")
        assert sorted(map(tuple, substring_dedup.remove_reference(frame, reference, window).collect())) == sorted(want)
    assert substring_dedup.remove_reference(frame.limit(0), reference).count() == 0
    monkeypatch.setattr(substring_dedup, "BROADCAST_WORDS", 10)
    with pytest.raises(ValueError, match="too large"):
        substring_dedup.remove_reference(frame, reference)
