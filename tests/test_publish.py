"""A publish composed of all its steps, on a small set of listings."""

import datetime as dt

from brindle.operators import publish as PB
from brindle.plans import QUERIES
from pyspark.sql import functions as F


def test_every_step_of_a_publish(spark):
    as_of = F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")
    at = lambda d, h=20, m=6: dt.datetime(2026, m, d, h)
    base = {"pool": "active", "source": "s", "location": "Far Hall", "lat": None, "lng": None, "cost": None, "url": "", "recurring": False}
    rows = [
        {"id": "dup-a", "name": "Harbor Swing Ball", "start_local": at(5), "cost": "Free"}, {"id": "dup-b", "name": "Harbor Swing Ball 6/5", "start_local": at(5), "cost": "$9"},
        {"id": "ser-1", "name": "Lamp Night", "start_local": at(26, m=5), "location": "Lamp House"}, {"id": "ser-2", "name": "Lamp Night", "start_local": at(2), "location": "Lamp House"}, {"id": "ser-3", "name": "Lamp Night", "start_local": at(9), "location": "Lamp House"},
        {"id": "folds", "name": "Tambo Social", "start_local": at(3, 21), "location": "Hall 3"}, {"id": "special", "name": "Tambo Social Anniversary", "start_local": at(10, 21), "location": "Hall 3"},
        {"id": "bad", "name": "Noise", "source": "unsure", "start_local": at(7)}, {"id": "past", "name": "Old Fair", "pool": "archive", "start_local": at(1, m=1)}, {"id": "waits", "name": "Pending Fair", "pool": "pending", "start_local": at(8)},
        {"id": "covers", "name": "Pop Up", "start_local": at(20), "location": "Hall 5"},
    ]
    fields = "ord long, id string, pool string, source string, name string, start_local timestamp_ntz, end_local timestamp_ntz, location string, lat double, lng double, cost string, url string, recurring boolean"
    full = [{**base, "ord": i, "end_local": r["start_local"] + dt.timedelta(hours=3), **r} for i, r in enumerate(rows)]
    listings = spark.createDataFrame([tuple(r[f.split()[0]] for f in fields.split(", ")) for r in full], fields)
    venues = [(3, "V3", "Tambo Social", "Hall 3", 3, "9:00 PM - 2:00 AM", False), (4, "V4", "Ghost Club", "Hall 4", 1, "late", True), (5, "V5", "Covered Club", "Hall 5", 1, "late", True)]
    venues = spark.createDataFrame([(*v[:5], v[5], "", None, None, v[6]) for v in venues], "pos long, id string, name string, location string, dow int, time_text string, note string, starts date, until_date date, approximate boolean")
    sources = spark.createDataFrame([("s", 1, False), ("unsure", 2, True)], "source string, source_rank long, unreliable boolean")
    excluded = spark.createDataFrame([("V3", dt.date(2026, 6, 3))], "id string, day date")
    out = PB.compose(listings, venues, sources, as_of, owners=spark.createDataFrame([("lamp-night-ser-1", "ser-1")], "slug string, id string")).collect()
    got = {r.id: r for r in out}
    assert set(got) == {"dup-a", "ser-1", "special", "covers", "past", "V3", "V4"}
    assert (got["dup-a"].members, got["dup-a"].price) == (2, 9.0)
    assert (got["ser-1"].start, got["ser-1"].stop, got["ser-1"].dates) == (at(2), at(2, 23), [at(26, m=5), at(2), at(9)])
    assert (got["V3"].start, got["V3"].stop) == (at(3, 21), at(4, 2))
    assert got["V4"].search_only and got["V4"].start is None and got["past"].archived and not got["special"].archived
    assert [r.id for r in out] == ["past", "ser-1", "V3", "dup-a", "special", "covers", "V4"]
    assert len({r.slug for r in out}) == len(out) and got["ser-1"].slug == "lamp-night-ser-1"
    later = {r.id: r for r in PB.compose(listings, venues, sources, as_of, excluded).collect()}
    assert later["V3"].start == at(10, 21) and "folds" in later


def test_a_publish_of_the_tables(spark):
    rows = QUERIES["publish_snapshot"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.slug for r in rows}) == len({r.id for r in rows}) == len(rows)
    starts = [r.start for r in rows if r.start]
    assert starts == sorted(starts) and any(r.members > 1 for r in rows) and any(r.dates > 1 for r in rows) and any(r.archived for r in rows)
