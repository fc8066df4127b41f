"""Queries that give out pairs: rows are shuffled, pairs aren't."""

import datetime as dt
import random

from brindle.functions import places as P
from brindle.functions.timefn import seconds_between
from brindle.operators import blocks as B
from brindle.operators import match as M
from brindle.operators import venues as V
from brindle.plans import QUERIES
from pyspark.sql import functions as F
from test_rules import listings


def above(df, node):
    """What the plan does after its last such node."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert node in text
    return text.split(node)[0]


def some_listings(spark, n, seed):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        x = pick.random()
        rows.append({
            "name": pick.choice(["Harbor Salsa", "Harbor Salsa Social", "Zouk Lab", "Kiz", "Kizomba Night", "Blue Door Swing", "Swing at Blue Door", "X", "Box", ""]), "location": pick.choice(["A", "B", "C", None]),
            "start_local": None if x < 0.1 else dt.datetime(2026, 1, 1 + pick.randrange(28), pick.randrange(24)), "lat": None if x > 0.8 else pick.choice([42.36, 42.3611, 64.1]), "lng": pick.choice([20.0, 20.006]),
            "url": pick.choice(["", "https://a.example/1", "https://a.example/2", "https://a.example/3"]) if x < 0.3 else "", "recurring": pick.random() < 0.5,
        })
    return listings(spark, *rows)


def test_candidates_hold_all_graded_pairs_once_and_none_is_shuffled(spark):
    rows = M.judged(some_listings(spark, 150, 3))
    found = M.gradable_pairs(rows)
    assert "Exchange" not in above(found, "Union")
    got = [(r.a, r.b) for r in found.filter("ao < bo").collect()]
    assert len(got) == len(set(got)) == found.count()
    side = lambda s: rows.select(F.struct(*rows.columns).alias(s))
    graded = M.graded(side("x").join(side("y"), F.col("x.ord") < F.col("y.ord"))).filter("grade is not null")
    assert {(r[0], r[1]) for r in graded.select("x.id", "y.id").collect()} <= set(got)
    mine, others = rows.filter("ord % 3 = 0"), rows.filter("ord % 3 > 0")
    across = [(r.a, r.b) for r in M.gradable_pairs(mine, others).collect()]
    one = {r.id for r in mine.collect()}
    assert sorted(across) == sorted(p for p in got if (p[0] in one) != (p[1] in one))


def test_reasons_need_no_join_of_pairs_with_their_rows(spark):
    rows = M.judged(some_listings(spark, 60, 4))
    sides = M.gradable_sides(rows, carry=("key", "norm", "day", "place"))
    told = sides.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), M.reason(sides).alias("reason"))
    assert "Exchange" not in above(told, "Union")
    joined = M.with_sides(M.gradable_pairs(rows), rows)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, joined.select("a", "b", M.reason(joined)).collect()))


def test_overlaps_come_up_where_they_are_given_out(spark):
    t = some_listings(spark, 200, 5).withColumn("day", F.to_date("start_local")).withColumn("end_local", F.expr("start_local + INTERVAL '1' HOUR * (ord % 5 - 1)"))
    clocks = F.array(*map(F.lit, ["9:00 PM - 2:00 AM", "late", "1:00 PM - 5:00 PM"]))
    nights = t.filter("location is not null and ord < 60").select(F.concat(F.lit("V"), "ord").alias("id"), F.col("ord").alias("pos"), "name", F.element_at(clocks, (F.col("ord") % 3 + 1).cast("int")).alias("time_text"), "location", "day")
    found = V.overlapping(t, nights)
    assert "Exchange" not in above(found, "Generate explode") and "Join" not in above(found, "Exchange")
    told = V.overlaps(V.collisions(t, nights)).select("id", "hub", "meets")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, told.collect()), key=repr) != []


def test_pairs_by_keys_are_spread_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 3)
    t = some_listings(spark, 120, 6)
    keys = {"url": F.nullif("url", F.lit("")), "place": F.col("location")}
    found = M.candidate_pairs(t, keys)
    assert "Exchange" not in above(found, "Generate explode") and "Join" not in above(found, "Exchange")

    def told(t):
        x, y = (t.select(F.struct("id", "ord", *(k.alias(n) for n, k in keys.items())).alias(s)) for s in "xy")
        return {tuple(r) for r in x.join(y, F.expr("x.ord < y.ord and (x.url = y.url or x.place = y.place)")).select("x.id", "y.id").collect()}

    got = list(map(tuple, found.collect()))
    assert len(got) == len(set(got)) and set(got) == told(t) != set()
    shared = t.withColumn("id", F.when(F.col("ord") % 10 == 0, "same").otherwise(F.col("id")))
    got = list(map(tuple, M.candidate_pairs(shared, keys).collect()))
    assert len(got) == len(set(got)) and set(got) == told(shared)


def query(name):
    return next(f.__closure__ for n, f in QUERIES.items() if n == name)[0].cell_contents


def test_pairs_of_a_place_are_spread_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 3)
    t = some_listings(spark, 150, 7)
    near, band = query("same_place")(t), query("band_join")(t)
    for found in (near, band):
        assert "Exchange" not in above(found, "Generate explode")
    x, y = (t.select(F.struct("id", "ord", "location", "lat", "lng", "start_local").alias(s)) for s in "xy")
    both = x.join(y, F.expr("x.ord < y.ord"))
    day = F.to_date("x.start_local") == F.to_date("y.start_local")
    km = P.distance_km(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng")) <= P.SAME_PLACE_KM
    told = both.filter(day & M.any_of(km, P.place_text(F.col("x.location")) == P.place_text(F.col("y.location")))).select("x.id", "y.id")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, told.collect())) != []
    told = both.filter((F.col("x.location") == F.col("y.location")) & (F.abs(seconds_between(F.col("x.start_local"), F.col("y.start_local"))) < 86400)).select("x.id", "y.id", day)
    assert sorted(map(tuple, band.collect())) == sorted(map(tuple, told.collect())) != []
