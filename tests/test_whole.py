"""Queries do the whole job: pairs of every branch of the grade, all rows, all dates."""

import datetime as dt
import math
import random

from brindle.functions.places import KM_PER_DEGREE
from brindle.operators import copies as CP
from brindle.operators import leads as LD
from brindle.operators import match as M
from brindle.operators import parse as R
from brindle.operators import series as S
from brindle.plans import QUERIES
from brindle.sources.adapters import view
from pyspark.sql import functions as F
from test_queries import duck  # noqa: F401
from test_rules import listings

SF = "/root/testdata/sf0.001"


def all_grades(rows):
    """Grades of all pairs of rows, without any key."""
    rows = M.prepared(rows)
    sides = lambda s: rows.select(F.struct(*rows.columns).alias(s))
    pairs = sides("x").join(sides("y"), F.col("x.ord") < F.col("y.ord")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "x", "y")
    return M.graded(pairs).filter("grade is not null").select("a", "b", "grade")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_pairs_of_every_branch_are_found(spark):
    weekly = {"name": "Harbor Salsa", "recurring": True, "location": "A"}
    near = {"location": "C", "lat": 42.3600, "lng": -71.0600}
    north = {"name": "Polar Ball", "lat": 64.10, "start_local": dt.datetime(2026, 6, 1, 20)}
    t = listings(
        spark, weekly, {**weekly, "start_local": dt.datetime(2026, 3, 13, 20)}, {"name": "Zouk Lab", "location": "B", "start_local": dt.datetime(2026, 1, 2, 23)},
        {"name": "Zouk Lab", "location": "B", "start_local": dt.datetime(2026, 1, 3, 1)}, {"name": "Mambo Club", **near}, {"name": "Mambo Club Live", **near, "location": "D", "lat": 42.3611},
        {"name": "Craft Fair", "location": "E"}, {"name": "Craft Fair", "location": "E", "start_local": dt.datetime(2026, 1, 7, 20)}, {"name": "Kiz", "location": "F", "start_local": dt.datetime(2026, 2, 1, 20)},
        {"name": "Big Kizomba Night", "location": "G", "start_local": dt.datetime(2026, 2, 2, 9)}, {"name": "Blue Door Swing", "location": "H", "start_local": dt.datetime(2026, 4, 2, 22)},
        {"name": "Swing at Blue Door", "location": "I", "start_local": dt.datetime(2026, 4, 3, 9)}, {**north, "lng": 20.000, "location": "J"}, {**north, "lng": 20.006, "location": "K"},
        {"name": "X", "location": "M", "start_local": dt.datetime(2026, 5, 1, 9)}, {"name": "Box", "location": "N", "start_local": dt.datetime(2026, 5, 1, 9)}, {"name": "", "location": "O"},
    )
    got = as_set(M.grade_pairs(t))
    assert {("L0", "L1", "certain"), ("L2", "L3", "certain"), ("L4", "L5", "certain"), ("L6", "L7", "review"), ("L8", "L9", "review"), ("L10", "L11", "review"), ("L12", "L13", "certain"), ("L14", "L15", "review")} <= got
    assert got == as_set(all_grades(t))


def test_no_pair_of_the_tables_is_missed(spark):
    t = view(spark, SF, "v_listing")
    assert as_set(M.grade_pairs(t)) == as_set(all_grades(t))


def test_one_address_and_a_common_night_is_one_listing(spark):
    d = lambda *days: [dt.datetime(2026, 1, x, 20) for x in days]
    one = {"url": "https://club.example/nights"}
    cases = [
        {"name": "Lindy Tuesdays", "start_local": d(6)[0], "recurrences": d(13, 20, 27), **one}, {"name": "Tango Lab", "start_local": d(20)[0], **one}, {"name": "Waltz Lab", "start_local": d(22)[0], **one},
        {"name": "Swing Hour", "start_local": d(27)[0], "recurrences": d(13, 22), **one}, {"name": "No Day", "start_local": None, **one}, {"name": "No Day Yet", "start_local": None, "recurrences": [None], **one},
        {"name": "Lindy Tuesdays", "start_local": d(13)[0], "location": "at 0", "recurring": True, **one}, {"name": "Only Later", "start_local": None, "recurrences": d(22), **one}, {"name": "Elsewhere", "start_local": d(20)[0], "url": "https://other.example"},
    ]
    plain = listings(spark, *({k: v for k, v in x.items() if k != "recurrences"} | {"location": x.get("location", f"at {i}")} for i, x in enumerate(cases)))
    dates = spark.createDataFrame([(i, x.get("recurrences")) for i, x in enumerate(cases)], "ord long, recurrences array<timestamp_ntz>")
    t = plain.join(dates, "ord")
    got = as_set(M.grade_pairs(t))
    assert got == as_set(all_grades(t))
    certain = {(a, b) for a, b, g in got if g == "certain"}
    dateless = {(min(x, y), max(x, y)) for x in ("L4", "L5") for y in ("L0", "L1", "L2", "L3", "L4", "L5", "L6", "L7") if x != y}
    assert len(got) == len({x[:2] for x in got})
    assert certain == dateless | {("L0", "L1"), ("L0", "L3"), ("L0", "L6"), ("L3", "L6"), ("L2", "L3"), ("L2", "L7"), ("L3", "L7")}
    new, old = t.filter("ord in (1, 2, 4)"), t.filter("ord not in (1, 2, 4)")
    across = {(r.id, r.other) for r in M.grade_against(M.judged(new), M.judged(old)).filter("grade = 'certain'").collect()}
    assert across == {(a, b) for x, y in certain for a, b in ((x, y), (y, x)) if a in ("L1", "L2", "L4") and b not in ("L1", "L2", "L4")}
    mixed = {(r.id, r.other) for r in M.grade_against(M.judged(plain.filter("ord in (1, 2, 4)")), M.judged(old)).filter("grade = 'certain'").collect()}
    assert mixed == across


def test_no_pair_of_listings_with_nights_is_missed(spark):
    t = view(spark, SF, "v_dated")
    assert as_set(M.grade_pairs(t)) == as_set(all_grades(t))


def test_signals_read_all_rows(spark):
    assert QUERIES["signal_match"](spark, SF).count() == 1000 and QUERIES["signal_explode"](spark, SF).count() == 2000


def test_feed_holds_old_rules_and_those_that_begin_in_the_window(spark, duck):  # noqa: F811
    starts = dict(duck.execute("SELECT 'L' || o_orderkey, o_orderdate::DATE FROM orders").fetchall())
    got = as_set(QUERIES["feed_recurrence"](spark, SF).select("uid"))
    assert min(starts[uid] for (uid,) in got) < dt.date(1998, 1, 1) and max(starts[uid] for (uid,) in got) >= dt.date(1998, 7, 1)


def test_an_old_rule_keeps_its_steps_and_its_count(spark):
    rules = [("a", "FREQ=DAILY;INTERVAL=3"), ("b", "FREQ=DAILY;COUNT=5"), ("c", "FREQ=DAILY;COUNT=3654"), ("d", "FREQ=DAILY;UNTIL=20150101")]
    feed = spark.createDataFrame([(u, dt.datetime(2016, 1, 1, 20), r) for u, r in rules], "uid string, start timestamp_ntz, rule string")
    got = sorted((r.uid, str(r.day)) for r in R.feed_dates(feed, F.lit("2026-01-02").cast("timestamp_ntz"), 1).collect())
    assert got == [("a", "2026-01-02"), ("a", "2026-01-05"), ("a", "2026-01-08"), ("c", "2026-01-01")]


def test_leaders_compare_location_keys_and_hubs(spark):
    t = listings(
        spark, {"name": "Harbor Salsa", "location": "Club, 107 Main Street, Boston"}, {"name": "Harbor Salsa", "location": "107 MAIN ST"}, {"name": "Harbor Salsa", "location": "7 Main St"}, {"name": "Harbor Salsa", "location": "8 Main St"},
        {"name": "Zouk", "location": None}, {"name": "Zouk", "location": ""}, {"name": "Zouk", "location": "Hall"}, {"name": "Harbor Salsa", "location": "107 Main St"}, {"name": "Zouk", "location": "H"},
    ).withColumn("hub", F.col("id") == "L7")
    got = {r.id: r.leader for r in S.leaders(t).collect()}
    assert got == {"L0": "L0", "L1": "L0", "L2": "L0", "L3": "L3", "L4": "L4", "L5": "L4", "L6": "L6", "L7": "L7", "L8": "L6"}


def test_leaders_of_all_published_rows(spark, duck):  # noqa: F811
    got = {r.id: r.leader for r in QUERIES["series_leaders"](spark, SF).collect()}
    ids = duck.execute("SELECT 'L' || o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_orderkey % 25) % 7 <> 6 UNION ALL SELECT 'V' || s_suppkey FROM supplier WHERE s_suppkey % 8 <> 7").fetchall()
    assert set(got) == {i for (i,) in ids} and all(got[leader] == leader for leader in got.values())
    assert all(i[0] == leader[0] for i, leader in got.items())


def test_rules_of_single_pairs(spark):
    """One pair for each rule, each in a place or name of its own."""
    club = {"location": "Havana Club", "recurring": True}
    later = dt.datetime(2026, 1, 16, 20)
    t = listings(
        spark, {**club, "name": "Havana Club Bachata Thursdays"}, {**club, "name": "Havana Club Salsa Thursdays", "start_local": later}, {"name": "Hub Night", "location": "B"}, {"name": "Hub Night", "location": "B"},
        {"name": "One", "location": "C", "id": "S"}, {"name": "Two", "location": "D", "id": "S", "start_local": dt.datetime(2026, 3, 1, 9)}, {"name": "Ring", "location": "E", "url": "http://a.b/x"},
        {"name": "Lamp", "location": "F", "url": "http://a.b/x", "start_local": None}, {"name": "Drum Fair", "location": "G"}, {"name": "Drum Fair", "location": "H", "start_local": None},
        {"name": "Harbor Swing Monday Ball", "location": "I", "recurring": True, "start_local": dt.datetime(2026, 2, 2, 20)}, {"name": "Harbor Swing Friday Ball", "location": "I", "recurring": True, "start_local": dt.datetime(2026, 2, 6, 20)},
        {"name": "Opera", "location": "Q1", "start_local": dt.datetime(2026, 5, 1, 9)}, {"name": "Opera", "location": "Q2", "start_local": dt.datetime(2026, 5, 1, 9)},
        {"name": "Ballet", "location": "R", "start_local": dt.datetime(2026, 6, 1, 9)}, {"name": "Ballet", "location": "R", "start_local": dt.datetime(2026, 6, 1, 9)},
    ).withColumn("hub", F.col("id") == "L3").withColumn("canon", F.expr("CASE WHEN location IN ('Q1', 'Q2') THEN 'q' WHEN id = 'L14' THEN 'r1' WHEN id = 'L15' THEN 'r2' END"))
    got = as_set(M.grade_pairs(t))
    assert got == as_set(all_grades(t))
    assert got == {("L0", "L1", "review"), ("S", "S", "certain"), ("L6", "L7", "certain"), ("L8", "L9", "review"), ("L12", "L13", "certain"), ("L14", "L15", "review")}


def test_classes_of_copies_stand_for_all_pairs(spark):
    """Best matches, totals and groups by classes of copies against all pairs: copies, shared and missing ids, places and names that match one way only, unknown starts."""
    draw, rows, km = random.Random(3), [], 0.0026 * KM_PER_DEGREE
    far, near = (math.sqrt(0.09 - km * km) / KM_PER_DEGREE / math.cos(math.radians(x)) for x in (64.1, 64.1026))  # degrees that are 0.3 km apart as seen from the south, and from the north
    for _ in range(170):
        lat, lng = draw.choice([(None, None), (64.10, 20.0), (64.1026, 20.0 + (far + near) / 2), (42.36, 20.0)])
        row = {"name": draw.choice(["Harbor Salsa", "Harbor Salsa Social", "Zouk Lab", "Zouk Lab Friday", "Blue Door Swing", "Swing at Blue Door", "Box", "X", ""]), "location": draw.choice([None, "A", "B"]), "recurring": draw.random() < 0.4}
        row |= {"start_local": draw.choice([None, *(dt.datetime(2026, 1, d, h) for d in (2, 3, 9) for h in (1, 20, 23))]), "lat": lat, "lng": lng}
        rows.append(row | {"url": draw.choice(["", "https://a.example/x", "https://b.example/y"])})
    rows = [row for row in rows for _ in range(draw.choice([1, 1, 2, 3]))]
    t = listings(spark, *rows)
    t = t.withColumn("id", F.when(F.col("ord") % 41 == 5, "twice").otherwise(F.col("id"))).localCheckpoint()
    judged = M.judged(t)
    g = M.prepared(t)
    sides = lambda s: g.select(F.struct(*g.columns).alias(s))
    all_pairs = M.graded(sides("x").join(sides("y"), F.col("x.ord") < F.col("y.ord"))).filter("grade is not null").select("x.id", "x.ord", F.col("y.id").alias("b"), F.col("y.ord").alias("bo"), "grade").collect()
    uneven = CP.class_grades(CP.classed(judged)[1]).filter("not fwd <=> back").count()
    assert uneven > 0
    best, first, n = {}, {}, {}
    for a, ao, b, bo, grade in all_pairs:
        best[a], best[b] = min(best.get(a, ("z",)), (grade, bo, b)), min(best.get(b, ("z",)), (grade, ao, a))
        first[b], n[grade] = min(first.get(b, "z"), grade), n.get(grade, 0) + 1
    assert as_set(CP.best_matches(judged).select("id", "grade", "other_ord", "other")) == {(i, *m) for i, m in best.items()}
    assert dict(map(tuple, CP.first_grades(judged).collect())) == first and dict(map(tuple, CP.totals(judged).collect())) == n
    sure = spark.createDataFrame([(a, b) for a, _, b, _, grade in all_pairs if grade == "certain"], "a string, b string")
    assert as_set(M.groups(CP.certain_links(judged))) == as_set(M.groups(sure)) != set()


def test_first_matches_of_a_batch_by_classes_of_copies(spark):
    """A batch against known rows, and its earlier rows, as by all pairs: copies in batch and pools, ids that are in several, missing ids."""
    draw, rows = random.Random(5), []
    for _ in range(120):
        row = {"name": draw.choice(["Harbor Salsa", "Harbor Salsa Social", "Zouk Lab", "Blue Door Swing", "Swing at Blue Door", "Box", ""]), "location": draw.choice([None, "A", "B"]), "recurring": draw.random() < 0.4}
        row |= {"start_local": draw.choice([None, *(dt.datetime(2026, 1, d, h) for d in (2, 3, 9) for h in (1, 20, 23))]), "url": draw.choice(["", "https://a.example/x", "https://b.example/y"])}
        rows += [row] * draw.choice([1, 1, 2, 4])
    t = listings(spark, *rows).withColumn("pool", F.element_at(F.array(F.lit("active"), F.lit("archive"), F.lit("pending"), F.lit(None)), (F.crc32(F.encode("id", "UTF-8")) % 4 + 1).cast("int")))
    t = t.withColumn("id", F.when(F.col("ord") % 31 == 5, "twice").when(F.col("ord") % 31 == 6, None).otherwise(F.col("id"))).localCheckpoint()
    new, old = M.judged(t.filter("ord % 3 = 1").withColumn("ord", F.col("ord") + 1000)), M.judged(t.filter("ord % 3 <> 1"), "pool")
    pool_of, want = {r.ord: r.pool for r in old.collect()}, {}
    for r in M.grade_against(new, old).collect():
        at = want.setdefault(r.ord, {})
        pool = pool_of[r.other_ord]
        at[pool], at["own"] = min(at.get(pool, ("z", 0)), (r.grade, r.other_ord)), at.get("own", False) or (r.id is not None and r.id == r.other and pool in ("active", "archive"))
    got = {r.ord: r for r in CP.first_known(new, old).collect()}
    assert set(got) == set(want) and any(x["own"] for x in want.values())
    for o, r in got.items():
        assert bool(r.own) == want[o]["own"] and all((r[p] and tuple(r[p])) == want[o].get(p) for p in CP.POOLS)
    earlier = {}
    for r in M.graded_pairs(new).collect():
        earlier[r.bo] = min(earlier.get(r.bo, ("z",)), (r.grade, r.ao, r.a or ""))
    assert {r.ord: (r.grade, r.other or "") for r in CP.earlier_matches(new).collect()} == {o: (g, a) for o, (g, _, a) in earlier.items()}


def test_leads_and_nights_are_those_of_all_pairs(spark):
    """Few names, places and addresses on two days, so that addresses are shared by names and places, and many have more than eight."""
    draw = random.Random(9)
    pick = lambda xs: draw.choice(xs)
    held = [(pick([1, 2]), pick(["a", "b", "c", None]), pick(["A", "B", "C", None]), pick([f"u{i}" for i in range(14)] + [None]), i) for i in range(70)]
    few = [(3, pick(["a", "b"]), pick(["A", "B"]), pick([f"u{i}" for i in range(25)]), 100 + i) for i in range(30)] + [(4, "a", pick(["A", "B"]), f"u{i % 9}", 200 + i) for i in range(5)] + [(4, "b", "A", f"u{i}", 300 - i) for i in range(20)]
    waits = [(f"w{i}", pick([1, 2, 3, 4, None]), pick(["a", "b", "c", "d", None]), pick(["A", "B", "C", None])) for i in range(60)]
    got = as_set(LD.first_leads(spark.createDataFrame(waits, "id string, day int, norm string, location string"), spark.createDataFrame(held + few, "day int, norm string, location string, url string, ord long")))
    want = set()
    for i, day, norm, place in waits:
        at = {}
        for d, n, p, url, o in held + few:
            for prio, same in ((1, n == norm and n is not None), (2, p == place and p is not None)):
                if d == day and same:
                    was = at.get(url, (9, 10**9))
                    at[url] = (min(was[0], prio), min(was[1], o))
        want |= {(i, url, at[url][0]) for url in sorted(at, key=at.get)[:8]}
    assert got == want


def test_pairs_are_spread_from_classes_of_copies(spark, monkeypatch):
    """All pairs of copies, over several blocks of a class, with an id that is there twice."""
    monkeypatch.setattr(CP, "_BLOCK", 2)
    rows = [{"name": "Harbor Salsa", "location": "A"}] * 5 + [{"name": "Swing at Blue Door", "location": "B"}] * 3 + [{"name": "Blue Door Swing", "location": "A", "start_local": None}] * 2 + [{"name": "Harbor Salsa Social", "location": "A"}] * 3
    t = listings(spark, *rows).withColumn("id", F.when(F.col("ord").isin(1, 6), "twice").otherwise(F.col("id")))
    assert sorted(map(tuple, M.grade_pairs(t).collect())) == sorted(map(tuple, all_grades(t).collect())) != []
