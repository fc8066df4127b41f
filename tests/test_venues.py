"""Venues that share a place."""

import datetime as dt

from brindle.operators import places as PL
from brindle.operators import venues as V
from pyspark.sql import functions as F
from test_rules import listings


def test_a_listing_meets_only_the_first_venue_of_its_night(spark):
    t = listings(spark, {"name": "Harbor Salsa", "location": "A"}, {"name": "Zouk", "location": "B"}, {"name": "Harbor Salsa", "location": None}).selectExpr("*", "start_local + interval 2 hours as end_local")
    night = dt.date(2026, 1, 2)
    rows = [(f"V{p}", p, "Harbor Salsa" if p == 3 else "Zouk", "8:00 PM - 11:00 PM", place, night) for p, place in [(9, "A"), (3, "A"), (5, "A"), (7, None)] + [(p, "B") for p in range(20, 60)]]
    nights = spark.createDataFrame(rows, "id string, pos long, name string, time_text string, location string, day date")
    first = V.collisions(t, V.first_nights(nights))
    assert first.count() == 2
    told = lambda hits: sorted(tuple(r) for r in V.verdicts(V.overlaps(hits)).select("id", "hub", "verdict").collect())
    assert told(first) == told(V.collisions(t, nights)) == [("L0", "V3", "fold"), ("L1", "V20", "fold")]


def test_places_are_inferred_for_rows_without_one(spark):
    rows = [("a", "Here", "at hall 7"), ("b", None, "at Hall 7!"), ("c", None, "\U0001f4cdPier 3\nat hall 7"), ("d", None, "at home"), ("e", None, None), ("f", "", "at hall 7"), ("g", None, "hall 7 annex")]
    venues = spark.createDataFrame([("Hall 7", "later", 9), ("hall 7", "first", 2), ("HALL 7 Annex", "annex", 5), (None, "none", 1)], "name string, place string, pos long")
    got = PL.inferred(spark.createDataFrame(rows, "id string, location string, t string"), F.col("t"), venues)
    assert {r.id: r.place for r in got.collect()} == {"a": "Here", "b": "first", "c": "Pier 3", "d": None, "e": None, "f": "", "g": "annex"}
