"""Spelling variants against a plain version that compares all words."""

import re
import zlib
from collections import Counter

from brindle.llm import variants
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain(counts):
    near = {w: [] for w in counts}
    halves = {}
    for w in counts:  # two words one edit apart are alike in their first or their last three letters
        for key in {("a", w[:3]), ("z", w[-3:])}:
            halves.setdefault(key, []).append(w)
    for group in halves.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    forms = {}
    for w, found in near.items():
        best = min(set(found), key=lambda v: (-counts[v], v.encode()), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, counts[w], len(set(near[w])), counts.get(forms[w])))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows_of(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_all_words(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_spelling_variants"](spark, SF)) == plain(plain_counts(docs))


def test_chains_runs_of_letters_and_many_parts(spark):
    import random

    draw, counts = random.Random(3), {}
    for _ in range(1500):
        word = "".join(draw.choice("abé") for _ in range(draw.randint(7, 9)))
        counts[word] = draw.choice([2, 2, 3, 25, 300, 4000, 50_000])
    counts |= {"a" * n: 10**n for n in range(7, 12)} | {"ÿ" * 400: 2, "ÿ" * 401: 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain(counts)
    assert rows_of(variants.group_variants(words)) == want and any(r[1] != r[2] for r in want if r[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert rows_of(variants.group_variants(words)) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "Strasse Straßen straßen STRASSEN strassen", 3), (3, "x" * 60_000 + " " + "x" * 60_000, 4), (3, "Élevage élevage-elevages ퟿ elevages", 5), (3, "Élevage élevage-elevages", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long")
    assert rows_of(variants.spelling_variants(docs)) == plain(plain_counts([(d, t) for d, t, _ in rows]))
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_spine_numbers_what_parts_share():
    keys = sorted({"abc", "abd", "abdx", "abdxy", "abe", "b", "ba", "bab", "c"})
    for cut in ([0], [0, 3], [0, 1, 2, 3, 4, 5, 6, 7, 8], [0, 4, 6]):
        spines = variants.spine([keys[i] for i in cut])
        numbers = {}
        for j, (a, b) in enumerate(zip(cut, [*cut[1:], len(keys)], strict=True)):
            trie = variants.Trie(j, spines)
            for key in keys[a:b]:
                for i, node in enumerate(trie.nodes(key)):
                    numbers.setdefault(key[:i], set()).add(node)
        assert all(len(found) == 1 for found in numbers.values())
        assert len({next(iter(found)) for found in numbers.values()}) == len(numbers)


def test_no_table_of_words_is_sent_whole(spark):
    """joins shuffle both sides; a table's file, by whose size Spark would send it to the driver and to all tasks, is far smaller than its rows in memory."""
    words = spark.createDataFrame([("harbours", 900), ("harbour", 40), ("harbourss", 30), ("festival", 50), ("festivals", 3)], "word string, n long")
    out = variants.group_variants(words)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.word: (r.form, r.root) for r in out.collect()}["harbour"] == ("harbours", "harbours")
