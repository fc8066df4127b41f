"""Rules on small inputs: names, clocks, places, links, groups."""

import datetime as dt

import pytest
from brindle.functions import names as N
from brindle.functions import places as P
from brindle.functions import text as X
from brindle.functions import timefn as T
from brindle.functions import urls as U
from brindle.operators import match as M
from brindle.operators import parse as R
from brindle.operators import publish as PB
from brindle.operators import series as S
from pyspark.sql import functions as F


def value(spark, column, **inputs):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items()), F.lit(0).alias("_")) if inputs else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("name", "want"), [("Salsa Social 9/12", "salsa social"), ("Bachata Night Vol. 3", "bachata night"), ("Tambó Social, Friday Oct 9th", "tambó social friday"), ("Latin Night #4!", "latin night"), ("", "")])
def test_normal_names(spark, name, want):
    assert value(spark, N.normalize_name(F.lit(name))) == want


def test_shared_words_match_each_word_once(spark):
    a, b = F.array(*map(F.lit, ["kizz", "kiss", "harbor"])), F.array(*map(F.lit, ["kiz", "harbor", "dj"]))
    assert value(spark, N.shared_word_count(a, b)) == 2


@pytest.mark.parametrize(("a", "b", "same"), [("harbor salsa", "harbor salsa friday", True), ("craft fair", "zouk night", False), ("kiz thursday social", "kizz thursday social", True), ("", "x", True)])
def test_series_names(spark, a, b, same):
    assert value(spark, N.same_series(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize(("text", "want"), [("Cover: $15 tonight", "Cover: $15"), ("free event", "Free"), ("pay $7", "$7"), ("it is free", "Free"), ("nothing", None), ("$10 at the door", "$10 at the door")])
def test_costs(spark, text, want):
    assert value(spark, X.extract_cost(F.lit(text))) == want


@pytest.mark.parametrize(("cost", "want"), [("", 0), ("Free!", 0), ("$10-15", 10), ("from 12.50", 12.5), ("ask", None)])
def test_prices(spark, cost, want):
    got = value(spark, X.parse_price(F.lit(cost)))
    assert (got is None and want is None) or float(got) == want


@pytest.mark.parametrize(("text", "want"), [("9:00 PM", 1260), ("12:15 am", 15), ("12:00 PM", 720), ("21:30", 1290), ("25:00", None), ("late", None)])
def test_clocks(spark, text, want):
    assert value(spark, T.parse_clock(F.lit(text))) == want


def test_every_other_week_counts_back_over_the_anchor(spark):
    days = [dt.date(2026, 1, 2), dt.date(2026, 1, 9), dt.date(2025, 12, 26), dt.date(2025, 12, 19)]
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in rows.select(T.schedule_admits(F.col("d"), F.lit("every other week"), F.lit(5), F.lit(None).cast("date"), F.lit(None).cast("date"))).collect()]
    assert got == [True, False, False, True]


def test_places(spark):
    assert value(spark, P.location_key(F.lit("Club, 12 Main Street, Boston"))) == "12 main st"
    assert value(spark, P.is_out_of_area(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("Dallas, TX 75001"))) is True
    assert value(spark, P.is_out_of_area(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("come on in"))) is False
    assert value(spark, P.is_out_of_area(F.lit(42.36), F.lit(-71.06), F.lit("x"))) is False


def test_links(spark):
    assert value(spark, U.url_rank(F.lit("https://www.facebook.com/events/s/x/1"))) == 40
    assert value(spark, U.url_key(F.lit("HTTPS://A.b/C//"))) == "https://a.b/c"
    verdict = lambda *a: value(spark, U.link_verdict(*(F.lit(x).cast("int") if isinstance(x, int) else F.lit(x).cast("string") if x is not None else F.lit(None) for x in a)))
    assert verdict("https://instagram.com/x", 200, "t", None, None) == "broken"
    assert verdict("https://x.org", None, "", "", "SSLError") == "broken"
    assert verdict("https://x.org", 429, "", "", None) == "unverifiable"


def test_groups_are_closed_and_do_not_depend_on_order(spark):
    links = [("d", "c"), ("b", "a"), ("c", "b"), ("x", "y")]
    for edges in (links, [(b, a) for a, b in reversed(links)]):
        got = {r["node"]: r["group"] for r in M.groups(spark.createDataFrame(edges, "a string, b string")).collect()}
        assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def listings(spark, *rows):
    base = {"pool": "active", "source": "s", "location": "Hall 1", "lat": None, "lng": None, "cost": None, "url": "", "recurring": False}
    full = [{**base, "ord": i, "id": f"L{i}", "start_local": dt.datetime(2026, 1, 2, 20), **r} for i, r in enumerate(rows)]
    schema = "ord long, id string, pool string, source string, name string, start_local timestamp_ntz, location string, lat double, lng double, cost string, url string, recurring boolean"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in full], schema)


def test_grades(spark):
    t = listings(
        spark, {"name": "Harbor Salsa"}, {"name": "Harbor Salsa 9/12"}, {"name": "Craft Fair"}, {"name": "Harbor Salsa", "location": "Far"}, {"name": "Zouk", "url": "http://a.b/x/", "location": "Q"},
        {"name": "Other", "url": "HTTP://a.b/x", "location": "R", "start_local": dt.datetime(2026, 1, 3, 10)},
    )
    got = {(r.a, r.b): r.grade for r in M.grade_pairs(t).collect()}
    assert got == {("L0", "L1"): "certain", ("L0", "L2"): "review", ("L1", "L2"): "review", ("L0", "L3"): "review", ("L1", "L3"): "review", ("L4", "L5"): "certain"}


def test_merging_is_idempotent(spark):
    t = listings(spark, {"name": "A", "cost": "Free"}, {"name": "B", "cost": "$5", "location": None}).withColumn("source_rank", F.col("ord")).withColumn("g", F.lit("g"))
    once = M.merged(t, "g").first()
    assert (once.id, once.name, once.location, once.cost, once.members) == ("L0", "A", "Hall 1", "$5", 2)


def test_leaders_follow_input_order(spark):
    t = listings(spark, {"name": "Harbor Salsa"}, {"name": "Harbor Salsa Friday"}, {"name": "Salsa Friday Club"}, {"name": "Harbor Salsa Anniversary"})
    got = {r.id: r.leader for r in S.leaders(t).collect()}
    assert got["L1"] == "L0" and got["L3"] == "L3"


def test_unique_slugs(spark):
    rows = spark.createDataFrame([("fiesta-2026-a", "Salsa Night"), ("fiesta-2026-b", "Salsa  night!"), ("fiesta-2026-c", "salsa night"), ("M1", "Fête Ķilo Ș ﬁne")], "id string, name string")
    slugs = {r.id: r.slug for r in PB.unique_slugs(rows).collect()}
    assert slugs["fiesta-2026-a"] == "salsa-night-fiesta-2" and slugs["M1"] == "fete-kilo-s-fine-m1" and len(set(slugs.values())) == 4
    owners = spark.createDataFrame([("salsa-night-fiesta-2", "fiesta-2026-b"), ("fete-kilo-s-fine-m1", "gone")], "slug string, id string")
    slugs = {r.id: r.slug for r in PB.unique_slugs(rows, owners).collect()}
    assert slugs["fiesta-2026-b"] == "salsa-night-fiesta-2" and slugs["M1"] == "fete-kilo-s-fine-m1" and len(set(slugs.values())) == 4


def test_alias_chains_end_after_ten_hops_and_at_what_is_not_live(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)] + [("x", "y")], "slug string, target string")
    got = {r.slug: r.target for r in PB.flatten_chains(links).collect()}
    assert got["n0"] == "n11" and got["n25"] == "n30" and got["x"] == "y"
    live = spark.createDataFrame([("n30",)], "slug string")
    got = {r.slug: r.target for r in PB.flatten_chains(links, live).collect()}
    assert got["n19"] == "n30" and got["n18"] is None and got["x"] is None


def test_addresses_resolve_in_order(spark):
    at, fields = dt.datetime(2026, 1, 2, 20), "slug string, id string, ord long, name string, location string, start_local timestamp_ntz, lat double, lng double"
    live = [
        ("a-new", "A", 1, "Alpha Night", "Hall 1, Main St", at, 42.0, -71.0), ("b-new", "B", 2, "Beta Club Social", "Hall 2", at, None, None), ("still", "S", 3, "Still Here", "Hall 3", at, None, None),
        ("tie1", "T", 4, "Gamma Big Ball", "Hall 4", at, None, None), ("tie2", "U", 5, "Gamma Big Ball", "Hall 4", at, None, None),
    ]
    old = [
        ("still", "x", 0, "Other", "Hall 9", at, None, None), ("a-old", "A", 0, "Whatever", "Elsewhere", at, None, None), ("g-old", "G", 0, "Nothing", "Nowhere", at, None, None), ("n-old", "q", 0, "alpha night!", "HALL 1", at, None, None),
        ("t-old", "q2", 0, "Beta Club", "The Hall 2 Annex", dt.datetime(2026, 1, 4, 19), None, None), ("t-near", "q3", 0, "Alpha Grand Night", "Far", at, 42.0010, -71.0), ("t-far", "q4", 0, "Alpha Grand Night", "Hall 1", at, 42.0030, -71.0),
        ("late", "q5", 0, "Beta Club", "Hall 2", dt.datetime(2026, 1, 4, 21), None, None), ("tied", "q6", 0, "Gamma Big", "Hall 4", at, None, None),
    ]
    same = spark.createDataFrame([("G", "B"), ("B", "B")], "node string, group string")
    got = {r.slug: (r.status, r.target, r.reason) for r in PB.resolve(spark.createDataFrame(old, fields), spark.createDataFrame(live, fields), same).collect()}
    ended = ("ended", None, None)
    assert got == {
        "still": ("live", None, None), "a-old": ("alias", "a-new", "renamed"), "g-old": ("alias", "b-new", "merged"), "n-old": ("alias", "a-new", "rescraped"), "t-old": ("alias", "b-new", "retitled"),
        "t-near": ("alias", "a-new", "retitled"), "t-far": ended, "late": ended, "tied": ended,
    }


def test_feed_rules(spark):
    rows = [("a", dt.datetime(2026, 1, 5, 20), "FREQ=WEEKLY;INTERVAL=2;COUNT=2"), ("b", dt.datetime(2026, 1, 5, 20), "FREQ=MONTHLY"), ("c", dt.datetime(2026, 1, 1), "FREQ=DAILY;UNTIL=20260103")]
    feed = spark.createDataFrame(rows, "uid string, start timestamp_ntz, rule string")
    got = sorted((r.uid, str(r.day), r.supported) for r in R.feed_dates(feed, F.lit("2026-01-02").cast("timestamp_ntz")).collect())
    assert got == [("a", "2026-01-05", True), ("a", "2026-01-19", True), ("b", "2026-01-05", False), ("c", "2026-01-01", True), ("c", "2026-01-02", True), ("c", "2026-01-03", True)]


def test_linked_data(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Event"],"name":"A &amp; B","startDate":"2026","location":"Hall","offers":{"price":0}},{"@type":"Place"}]}</script><script type="application/ld+json">{oops</script>'
    got = R.jsonld_events(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [tuple(r) for r in got] == [(1, "A & B", "2026", "Hall", "Free")]


@pytest.mark.parametrize(
    ("text", "utc", "iso"),
    [
        ("2026-07-01T20:00:00", "2026-07-02 00:00:00", "2026-07-01T20:00:00-04:00"), ("2026-01-01 20:00", "2026-01-02 01:00:00", "2026-01-01T20:00:00-05:00"), ("2026-07-01T20:00:00Z", "2026-07-01 20:00:00", "2026-07-01T16:00:00-04:00"),
        ("2026-07-01T20:00:00+0530", "2026-07-01 14:30:00", "2026-07-01T10:30:00-04:00"), ("2026-07-01T20:00:00-07", "2026-07-02 03:00:00", "2026-07-01T23:00:00-04:00"), ("2026-03-08T02:30:00", "2026-03-08 07:30:00", "2026-03-08T03:30:00-04:00"),
        ("2026-11-01T01:30:00", "2026-11-01 05:30:00", "2026-11-01T01:30:00-04:00"), ("2026-11-01T06:30:00Z", "2026-11-01 06:30:00", "2026-11-01T01:30:00-05:00"), ("2026-07-01", "2026-07-01 04:00:00", "2026-07-01T00:00:00-04:00"), ("soon", None, None), ("", None, None),
    ],
)
def test_instants(spark, text, utc, iso):
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            at = T.parse_instant(F.lit(text))
            got = spark.range(1).select(T.utc_clock(at).cast("string").alias("u"), T.iso_local(at).alias("i")).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert (got.u, got.i) == (utc, iso)


def test_local_days_last_as_long_as_the_clock_says(spark):
    days = [dt.date(2026, 3, 8), dt.date(2026, 7, 1), dt.date(2026, 11, 1)]
    b = T.day_bounds(F.col("d"))
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(F.timestamp_diff("HOUR", b["first"], b["end"]).alias("h")).collect()
    assert [r.h for r in rows] == [23, 24, 25]
