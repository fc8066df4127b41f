"""Secret scans against a plain version of the patterns, and guess costs of values whose order is known."""

import hashlib
import re

from brindle.llm import secrets
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = {w: i for i, w in enumerate(["the", "password", "welcome", "house", "dragon", "letter"], 1)}


def plain_base(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, name, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return [x for _, _, x in sorted(out)]


def held(rows, texts):
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("guess:")] == base
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert r.n_guess == r.spans.count("guess:")


def test_query_holds_against_the_plain_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op11_secret_guess_cost"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    held(rows, texts)


def test_odd_texts(spark):
    texts = [
        None, "", "secret=token:abcdefgh", "TOKEN : 'a.b-c/d+e=f_g'", "paſsword=abcdefgh", "é" * 7 + " api_key=" + "z" * 50, "AKIAAKIA" + "Q" * 9, "AKIA" + "A" * 16 + "b", "deadbeef" * 3 + "g" + "0" * 23,
        'password = "p@ss!x#9Qv&Lz2"', "pwd: welcome", 'passphrase: "the dragon house letter"', "https://ann:q7#Zk!x93Lw@host/path", "token: asdfghjkl;", "auth=20240131", "x" * 200_000 + " passwd=" + "Ab9$" * 2_000,
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "token=abcdef", None), (3, texts[3], "again")], "doc_id long, text string, found string")
    got = secrets.secret_digests(docs, words=100).collect()
    assert len(got) == len(texts) + 2
    held([r for r in got if r.doc_id is not None], dict(enumerate(texts)))
    assert [r.spans for r in got if r.doc_id is None] == ["assign:0:12"]
    assert secrets.secret_digests(docs.limit(0)).count() == 0
    found = {i: [s for s in secrets.spans(t, RANKS) if s.kind == 3] for i, t in enumerate(texts)}
    assert [texts[9][s.start : s.end] for s in found[9]] == ["p@ss!x#9Qv&Lz2"] and [texts[12][s.start : s.end] for s in found[12]] == ["q7#Zk!x93Lw"]
    assert not any(found[i] for i in (0, 1, 10, 11, 13, 14))
    hidden = {r.doc_id: r.text for r in secrets.redacted(docs, RANKS).collect()}
    assert hidden[9] == 'password = "[secret]"' and hidden[10] == texts[10] and hidden[0] is None and hidden[12] == "https://ann:[secret]@host/path"


def brute_bits(value, costs):
    """The cheapest of all segmentations into spans of known cost, the rest by character: all of them are tried."""
    if not value:
        return 0.0
    return min([secrets._tried(value[0]) + brute_bits(value[1:], costs)] + [c + brute_bits(value[len(s) :], costs) for s, c in costs.items() if value.startswith(s)])


def test_guess_cost_is_the_cheapest_segmentation():
    import math

    costs = {w: 1 + math.log2(r) for w, r in RANKS.items()} | {"2019": 1 + secrets.YEAR_BITS, "20190704": 1 + secrets.DAY_BITS}
    for value in ("thehouse", "dragon2019", "xthedragonq", "20190704the", "letterhouse7", "bvnpwkeh"):
        assert abs(secrets.guess_bits(value, RANKS) - brute_bits(value, costs)) < 1e-9, value
    cost = lambda v: secrets.guess_bits(v, RANKS)
    assert cost("P4ssword") > cost("password") and cost("aaaaaaaa") < 10 and cost("abcabcabc") < cost("abcdefghi") and cost("qwertyuiop") < 30 < cost("qzxjvmpwkt")
    assert cost("kX9#vQ2!pL") > 40 and cost("") == 0 and cost("éàü") == 21
