"""Retitled rows are found by classes of titles and places."""

import datetime as dt
import random
import unicodedata

import pandas as pd
from brindle.functions import names as N
from brindle.operators import publish as PB
from pyspark.sql.functions import pandas_udf

SCHEMA = "slug string, name string, location string, start_local timestamp_ntz, lat double, lng double"
WORDS = {"Harbor Salsa": {"harbor", "salsa"}, "Harbor Salsa Reunion": {"harbor", "salsa", "reunion"}, "Zouk Lab": {"zouk", "lab"}, "Zouk Harbor": {"zouk", "harbor"}}


def rows(n, mark, seed):
    pick = random.Random(seed)
    at = lambda: pick.choice([(42.36, -71.06), (42.3612, -71.06), (64.1, 20.0), (64.1, 20.003), (None, 20.0), (42.36, None)])
    return [(f"{mark}{i}" if i % 9 else f"both{i}", pick.choice(list(WORDS)), pick.choice(["Hall 1, Main", "Hall 12, Main", "Annex", None, ""]), dt.datetime(2026, 1, 1 + pick.randrange(20), pick.choice([0, 20])), *at()) for i in range(n)]


def by_hand(register, live):
    import math

    out = {}
    for slug, name, place, start, lat, lng in register:
        found = []
        for s, n, p, t, y, x in live:
            if s == slug or abs(t - start) > dt.timedelta(days=2):
                continue
            if None in (lat, lng, y, x):
                a, b = ((q or "").split(",")[0].strip().lower() for q in (place, p))
                near = bool(a and b) and (a in b or b in a)
            else:
                near = math.hypot((lat - y) * 111, (lng - x) * 111 * math.cos(math.radians((lat + y) / 2))) <= 0.2
            alike = len(WORDS[name] & WORDS[n]) / len(WORDS[name] | WORDS[n])
            if near and alike >= 0.5:
                found.append((alike, s))
        best = [s for a, s in found if a == max(found)[0]]
        if len(best) == 1:
            out[slug] = best[0]
    return out


def test_rows_alike_in_title_place_and_start_have_one_answer(spark):
    register, live = rows(60, "r", 1), rows(60, "n", 2)
    r, n = (spark.createDataFrame(x, SCHEMA) for x in (register, live))
    got = PB.retitled(r, n).collect()
    assert {x.slug: x.target for x in got} == by_hand(register, live) != {} and len(got) == len({x.slug for x in got})
    titles = PB.alike_titles(r, n, 0.5).collect()  # each two titles once, however many rows have them
    assert len(titles) == len({(x.r_name, x.n_name) for x in titles}) == sum(len(a & b) / len(a | b) >= 0.5 for a in WORDS.values() for b in WORDS.values())


def test_only_names_that_are_not_ascii_pass_through_python(spark, monkeypatch):
    @pandas_udf("string")
    def decomposed(text: pd.Series) -> pd.Series:
        assert len(text) == 0 or not text.map(lambda t: t is None or t.isascii()).any()
        return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    monkeypatch.setattr(N, "_decomposed", decomposed)
    t = spark.createDataFrame([("a1", "Harbor Salsa!"), ("b2", "Café Ñandú"), ("c3", None), ("d4", "-- 日本 --"), ("e5", "")], "id string, name string")
    assert {tuple(r) for r in PB.unique_slugs(t).collect()} == {("a1", "harbor-salsa-a1"), ("b2", "cafe-nandu-b2"), ("c3", "c3"), ("d4", "-d4"), ("e5", "-e5")}
    assert {(r.id, r.name) for r in PB.unique_slugs(t, carry=("name",)).collect()} == {(r.id, r.name) for r in t.collect()}


def test_addresses_are_resolved_by_classes_of_name_and_location(spark, monkeypatch):
    names, places = ["Harbor Salsa", "Zouk Lab", None], ["Hall 1, Main", "Annex", None]
    day = dt.datetime(2026, 1, 5)
    register = [(f"r{i}", f"R{i}", names[i % 3], places[i // 3 % 3], day, None, None) for i in range(90)] + [("twice", "T", "Zouk Harbor", "Hall 1, Main", day, None, None)] * 2
    live = [("n1", "N1", 1, "Harbor Salsa #4", "Hall 1, Side", day, None, None), ("n2", "R4", 2, "Other", "Far", day, None, None), ("n3", "N3", 3, "Zouk Lab", "", day, None, None), ("n4", "N4", 4, "Harbor Salsa", "HALL 1", day, None, None), ("n5", "N5", 5, "Zouk", "Hall 1", day, None, None)]
    sizes = {}
    kept = PB.kept
    monkeypatch.setattr(PB, "kept", lambda df: sizes.setdefault(tuple(df.columns), kept(df)))
    r = spark.createDataFrame(register, "slug string, id string, name string, location string, start_local timestamp_ntz, lat double, lng double")
    n = spark.createDataFrame(live, "slug string, id string, ord long, name string, location string, start_local timestamp_ntz, lat double, lng double")
    same = spark.createDataFrame([("R7", "g"), ("N3", "g"), ("R13", "alone")], "node string, group string")
    got = PB.resolve(r, n, same).collect()
    assert sizes["name", "location"].count() == 10  # names are made normal once for each class, not for each row
    want = {s: ("alias", "n1", "rescraped") for s in (f"r{i}" for i in range(90) if i % 3 == 0 and i // 3 % 3 == 0)}
    want |= {s: ("alias", "n3", "rescraped") for s in (f"r{i}" for i in range(90) if i % 3 == 1 and i // 3 % 3 == 2)}
    want |= {s: ("alias", "n5", "retitled") for s in (f"r{i}" for i in range(90) if i % 3 == 1 and i // 3 % 3 == 0)}
    want |= {"r4": ("alias", "n2", "renamed"), "r7": ("alias", "n3", "merged"), "twice": ("alias", "n5", "retitled")}
    assert {x.slug: tuple(x[1:]) for x in got} == {s: want.get(s, ("ended", None, None)) for s in (x[0] for x in register)}
    assert len(got) == len(register)


def test_the_best_within_days_is_found_without_meeting_one_by_one(spark):
    pick = random.Random(5)
    time = lambda: dt.datetime(2026, 1, 1 + pick.randrange(9), pick.choice([0, 7, 20]), 0, 0, pick.choice([0, 1]))
    asked = list({(pick.choice("ab"), pick.randrange(2), time()) for _ in range(90)})
    seen = list({(pick.choice("ab"), pick.randrange(2), pick.choice([0.5, 0.6, 1.0]), time()): (pick.choice([1, 1, 2]), f"n{i}") for i in range(14)}.items())
    a = spark.createDataFrame(asked, "r_name string, r_place long, r_start timestamp_ntz")
    s = spark.createDataFrame([(*k, *v) for k, v in seen], "r_name string, r_place long, x double, n_start timestamp_ntz, n long, target string")
    want = {}
    for name, place, start in asked:
        near = [(x, n, slug) for (r, p, x, at), (n, slug) in seen if (r, p) == (name, place) and abs(at - start) <= dt.timedelta(days=2)]
        best = [(n, slug) for x, n, slug in near if x == max(near)[0]]
        if [n for n, _ in best] == [1]:
            want[name, place, start] = best[0][1]
    found = PB.best_within(a, s, 2)
    assert {tuple(r[:3]): r.target for r in found.collect()} == want and 10 < len(want) < len(asked) - 10
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
