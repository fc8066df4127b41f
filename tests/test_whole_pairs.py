"""Queries of pairs give out all of them: more than any list of the first few would hold."""

import datetime as dt
import random

import __spark_entry__ as E
from brindle.operators import leads as LD


def orders(spark, path, rows):
    """A folder of one orders table, of (key, customer, status, day) rows."""
    table = [(k, cust, status, 1.0, dt.datetime(1998, 1, day), "") for k, cust, status, day in rows]
    frame = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(table, frame).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_a_night_has_all_others_of_its_place(spark, tmp_path):
    """nine at one place and night have eight others each, not five; none at another place, on another night or without a place."""
    rows = [(24 * i, 40 * i + 1, "O", 5) for i in range(9)] + [(1001, 2, "O", 5), (24 * 50, 81, "O", 6), (24 * 60, 26, "O", 5), (24 * 61, 26, "O", 5)]
    got = sorted(map(tuple, E.queries()["nearby_night"](spark, orders(spark, tmp_path, rows)).collect()))
    halls = {f"L{k}": cust % 40 for k, cust, _, _ in rows if cust % 13}
    days = {f"L{k}": day for k, _, _, day in rows}
    assert got == sorted((a, b) for a in halls for b in halls if a != b and halls[a] == halls[b] and days[a] == days[b])
    assert max(sum(a == x for a, _ in got) for x in halls) > 5


def test_leads_are_all_addresses_of_the_night(spark, monkeypatch):
    """more than eight addresses of one name and of one place, each once with its lower prio; missing names, places, days and addresses; over several blocks."""
    from brindle.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 3)
    draw = random.Random(4)
    pick = lambda xs: draw.choice(xs)
    held = [(pick([1, 2]), pick(["a", "b", "c", None]), pick(["A", "B", "C", None]), pick([f"u{i}" for i in range(40)] + [None])) for i in range(150)]
    waits = [(f"w{i}", pick([1, 2, 3, None]), pick(["a", "b", "d", None]), pick(["A", "B", None])) for i in range(40)]
    got = sorted(map(repr, map(tuple, LD.leads(spark.createDataFrame(waits, "id string, day int, norm string, location string"), spark.createDataFrame(held, "day int, norm string, location string, url string")).collect())))
    want = {}
    for i, day, norm, place in waits:
        for d, n, p, url in held:
            for prio, same in ((1, n == norm and n is not None), (2, p == place and p is not None)):
                if d == day and same:
                    want[i, url] = min(want.get((i, url), 9), prio)
    assert got == sorted(repr((i, url, prio)) for (i, url), prio in want.items()) and len(got) > 40 * 8


def test_classes_of_given_rows_are_those_of_judged_ones(spark):
    """F2, F5, F6, F8 to F12, F16 to F18, F21: listings as they are give what judged ones give, with names and places that differ by case and spaces, copies, ids that are there twice, missing ids and -0.0."""
    from brindle.operators import copies as CP
    from brindle.operators import match as M

    draw, rows = random.Random(11), []
    for _ in range(90):
        row = (draw.choice(["Harbor Salsa", "harbor  SALSA", "Zouk Lab", "Blue Door Swing", "Swing at Blue Door", "", None]), draw.choice([None, "A", "a ", "B"]), draw.choice(["", "https://a.example/x", "https://A.example/x/"]))
        row += (draw.choice([None, *(dt.datetime(2026, 1, d, h) for d in (2, 3, 9) for h in (1, 20))]), draw.choice([None, (0.0, 1.0), (-0.0, 1.0), (50.0, 1.0)]), draw.random() < 0.4)
        rows += [row] * draw.choice([1, 1, 2, 4])
    frame = "id string, ord long, name string, location string, url string, start_local timestamp_ntz, lat double, lng double, recurring boolean, source string, pool string"
    for odd in (False, True):
        ids = [None if odd and i % 31 == 6 else "twice" if odd and i % 31 == 5 else f"r{i}" for i in range(len(rows))]
        t = spark.createDataFrame([(ids[i], i, n, p, u, s, *(at or (None, None)), r, "s", draw.choice(["active", "pending"])) for i, (n, p, u, s, at, r) in enumerate(rows)], frame).localCheckpoint()
        judged = M.judged(t)
        told = lambda frame: sorted(map(repr, map(tuple, frame.collect())))
        for job in (CP.best_matches, CP.first_grades, CP.totals, CP.earlier_matches, CP.pairs):
            assert told(job(t)) == told(job(judged)) != []
        want = M.groups(M.graded_pairs(judged).filter("grade = 'certain'").select("a", "b"))
        assert told(CP.certain_groups(t)) == told(want) == told(M.groups(CP.certain_links(t))) != []
        best = {r.b: r.grade for r in CP.first_grades(judged).collect()}
        assert told(CP.row_grades(t, "ord")) == sorted(repr((i, best.get(i), o)) for o, i in enumerate(ids))
        some = {r.id: (r.other, r.grade) for r in CP.best_matches(t, carry=("name", "pool"), where="pool = 'pending'").collect()}
        pending = {r.id for r in t.filter("pool = 'pending'").collect()}
        assert {i: x for i, x in some.items() if i in pending} == {r.id: (r.other, r.grade) for r in CP.best_matches(judged).collect() if r.id in pending}
