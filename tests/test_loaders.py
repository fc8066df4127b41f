"""Registry files, places by tables, verification by facts."""

import datetime as dt
import json

from brindle.operators import audit as A
from brindle.operators import lifecycle as LC
from brindle.operators import parse as R
from brindle.operators import places as PL
from brindle.operators import search as Q
from brindle.sources import loaders as LD
from pyspark.sql import functions as F


def test_registry_files(spark, tmp_path):
    (tmp_path / "sources.json").write_text(json.dumps({"sources": [{"id": "a", "name": "A", "enabled": True, "noise": 5, "active_months": [6, 7]}, {"id": "b", "name": "B", "trusted": True}]}))
    got = [(r.id, r.source_rank, r.enabled, r.trusted, r.active_months) for r in LD.load_sources(spark, f"{tmp_path}/sources.json").collect()]
    assert got == [("a", 0, True, False, [6, 7]), ("b", 1, False, True, None)]
    rows = LD.load_sources(spark, f"{tmp_path}/sources.json").select("id", LD.off_season(F.col("active_months"), F.lit("2026-01-05").cast("date")).alias("o"))
    assert {r.id: r.o for r in rows.collect()} == {"a": True, "b": False}
    (tmp_path / "aliases.json").write_text(json.dumps({"_notes": ["x"], "Havana": [" Club Havana ", "288 Green"], "Zoo": ["the zoo"]}))
    assert [(r.alias, r.place) for r in LD.load_aliases(spark, f"{tmp_path}/aliases.json").orderBy("pos").collect()] == [("havana", "Havana"), ("club havana", "Havana"), ("288 green", "Havana"), ("zoo", "Zoo"), ("the zoo", "Zoo")]
    venues = [{"id": "v", "name": "V", "location": "L", "schedule": [{"dayOfWeek": "Monday", "time": "9:00 PM - 1:00 AM"}, {"dayOfWeek": "Friday", "time": "", "note": "1st Friday", "starts": "2026-01-01"}], "excludeDates": ["2026-02-01"]}, {"id": "w", "name": "W"}]
    (tmp_path / "venues.json").write_text(json.dumps(venues))
    v, entries = LD.load_venues(spark, f"{tmp_path}/venues.json")
    assert [(r.id, r.pos, r.excludeDates) for r in v.orderBy("pos").collect()] == [("v", 0, ["2026-02-01"]), ("w", 1, None)]
    assert [(r.day_of_week, r.note, r.starts) for r in entries.collect()] == [("Monday", "", None), ("Friday", "1st Friday", dt.date(2026, 1, 1))]


def test_submissions_and_pages(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i, s in enumerate([{"event_name": "N", "recurrence_type": "weekly"}, {"event_name": " "}, {"event_name": "M", "recurrence_type": "hourly"}, {"event_name": "D", "date": "2026-02-31"}]):
        (inbox / f"{i}.json").write_text(json.dumps(s))
    (inbox / "9.json").write_text("{oops")
    good, bad = LD.read_submissions(spark, str(inbox))
    assert [r.event_name for r in good.collect()] == ["N"]
    assert {(r.file, r.reason) for r in bad.collect()} == {("1.json", "no name"), ("2.json", "recurrence"), ("3.json", "date"), ("9.json", "no JSON")}
    at = lambda d: dt.datetime(2026, 1, d)
    spark.createDataFrame([("u", "s", 200, "old", at(1)), ("u", "s", 404, "new", at(2)), ("w", "s", 200, "x", at(1))], LD.PAGES).write.parquet(f"{tmp_path}/pages")
    assert sorted((r.url, r.status, r.body) for r in LD.read_raw_pages(spark, f"{tmp_path}/pages").collect()) == [("u", 404, "new"), ("w", 200, "x")]


def test_places_by_tables(spark):
    t = spark.createDataFrame([("1", "The Havana Club, 288 Green St"), ("2", "havana"), ("3", None), ("4", "Savannah"), ("5", "Up at 288 Green St, Cambridge")], "id string, location string")
    aliases = spark.createDataFrame([("van", "short", 5), ("havana", "exact", 9), ("288 green st", "address", 1)], "alias string, place string, pos long")
    assert {r.id: r.place for r in PL.canonical(t, aliases).collect()} == {"1": "address", "2": "exact", "3": None, "4": "short", "5": "address"}
    known = spark.createDataFrame([("Havana", 7), ("288 Green St", 3), ("Vanna", 1)], "key string, pos long")
    assert {r.id: r.pos for r in PL.looked_up(t, known).collect()} == {"1": 7, "2": 7, "3": None, "4": None, "5": 3}
    text = spark.createDataFrame([("1", None, "at Zoo or the Big Zoo"), ("2", None, "\U0001f4cd Pier 4\nmore"), ("3", "Here", "Zoo"), ("4", None, None)], "id string, location string, about string")
    venues = spark.createDataFrame([("Zoo", "z", 1), ("Big Zoo", "bz", 2)], "name string, place string, pos long")
    assert {r.id: r.place for r in PL.inferred(text, F.col("about"), venues).collect()} == {"1": "bz", "2": "Pier 4", "3": "Here", "4": None}
    feed = spark.createDataFrame([("u1", "Zoo"), ("u2", " ZOO "), ("u3", "x")], "uid string, location string")
    points, coded = spark.createDataFrame([("u1", 1.0, 2.0)], "uid string, lat double, lng double"), spark.createDataFrame([("zoo", 3.0, 4.0)], "location string, lat double, lng double")
    assert {r.uid: (r.lat, r.lng) for r in PL.geo_by_uid(feed, points, coded).collect()} == {"u1": (1.0, 2.0), "u2": (3.0, 4.0), "u3": (None, None)}


def test_every_verification_status(spark):
    at, late = dt.datetime(2026, 5, 1, 20), dt.datetime(2026, 5, 2, 20)
    base = {"url": "https://a.example/e", "recurring": False, "start_local": at, "location": "Hall 1, Main St", "error": None, "http": 200, "structured": True, "declared": None, "cancel_word": False, "source_start": at, "source_place": "hall 1", "fetched_at": None, "attested": None, "attested_until": None, "trusted": False, "searched_at": None}
    cases = {
        "confirmed": {}, "attested_ok": {"attested": "attested_ok", "attested_until": late, "http": 404}, "no_source": {"url": ""}, "calendar_only": {"url": None, "trusted": True, "searched_at": dt.datetime(2026, 4, 25)}, "needs_browser": {"url": "https://facebook.com/events/1"},
        "unverifiable": {"url": "https://instagram.com/p"}, "unreachable": {"error": "Timeout", "http": None}, "page_gone": {"http": 410}, "cancelled": {"declared": "cancelled"}, "needs_review": {"cancel_word": True}, "date_mismatch": {"source_start": late, "source_place": "Elsewhere Park"},
        "location_mismatch": {"source_place": "Elsewhere Park"}, "reachable_only": {"structured": False},
    }
    more = {"m1": ({"cancel_word": True, "declared": "scheduled"}, "confirmed"), "m2": ({"source_start": late, "recurring": True}, "confirmed"), "m3": ({"source_start": late, "fetched_at": late, "source_place": None}, "reachable_only"), "m4": ({"source_start": None, "source_place": None, "declared": "scheduled"}, "confirmed"), "m5": ({"url": "", "trusted": True, "searched_at": dt.datetime(2026, 3, 1)}, "no_source")}
    rows = [{"id": k, **base, **v} for k, v in cases.items()] + [{"id": k, **base, **v} for k, (v, _) in more.items()]
    t = spark.createDataFrame([(r["id"], r["url"], r["recurring"], r["start_local"], r["location"]) for r in rows], "id string, url string, recurring boolean, start_local timestamp_ntz, location string")
    names = "error string, http int, structured boolean, declared string, cancel_word boolean, source_start timestamp_ntz, source_place string, fetched_at timestamp_ntz, attested string, attested_until timestamp_ntz, trusted boolean, searched_at timestamp_ntz"
    facts = spark.createDataFrame([(r["id"], *(r[n.split()[0]] for n in names.split(", "))) for r in rows], f"id string, {names}")
    got = {r.id: r.status for r in A.verify(t, facts, F.lit(at)).collect()}
    assert got == {**{k: k for k in cases}, **{k: s for k, (_, s) in more.items()}}


def test_readiness_and_gate(spark):
    found = spark.createDataFrame([("coordinates", 2), ("facebook_signals", 1), ("reachable_only", 3), ("verification", 0)], "check_name string, n long")
    got = {r.check_name: (r.status, r.n) for r in Q.readiness(found).collect()}
    assert len(got) == 13 and got["coordinates"] == ("blocker", 2) and got["facebook_signals"] == ("warning", 1) and got["verification"] == ("warning", 3) and got["start_hours"] == ("ok", 0)
    none, links = spark.range(0), spark.createDataFrame([("ok",)], "verdict string")
    assert not Q.publish_gate(Q.readiness(found), none, links).first().open
    assert Q.publish_gate(Q.readiness(found.filter("check_name <> 'coordinates'")), none, links).first().open
    assert not Q.publish_gate(Q.readiness(found.limit(0)), none, spark.createDataFrame([("broken",)], "verdict string")).first().open


def test_signals_blocks_and_empty_pages(spark):
    s = lambda *rows: spark.createDataFrame(rows, "source string, day string, text string")
    got = LC.upsert_signals(s(("a", "1", "old"), ("b", "1", "kept"), ("b", "2", "no")), s(("a", "3", "new")), s(("b", "2", "")))
    assert sorted(r.text for r in got.collect()) == ["kept", "new"]
    old = spark.createDataFrame([("x", "s", "old key", "spam"), ("y", "s", "k", "spam")], "id string, source string, key string, category string")
    said = spark.createDataFrame([("y", "unblock", None, 1), ("z", "block", "class", 2), ("x", "block", "class", 3), ("w", "block", "c", 1), ("w", "unblock", None, 2)], "id string, choice string, category string, seq long")
    rows = spark.createDataFrame([("x", "s", "New", "H"), ("z", "t", "Zouk Lab #4", " Hall 1 "), ("w", "t", "W", "H")], "id string, source string, name string, location string")
    assert sorted(map(tuple, LC.blocklist(old, said, rows).collect())) == [("x", "s", "old key", "spam"), ("z", "t", "zouk lab|hall 1", "class")]
    pages = spark.createDataFrame([(1, '<div data-hook="events">{"count": 0}</div>'), (2, '<div data-hook="events">{"count": 3}</div>'), (3, '{"count":0}'), (4, None)], "i long, html string")
    assert {r.i: r.e for r in pages.select("i", R.declares_empty(F.col("html")).alias("e")).collect()} == {1: True, 2: False, 3: False, 4: False}
