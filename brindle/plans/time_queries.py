"""Queries over occurrences: series, venues, calendars."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timefn as T
from ..functions.names import SPECIAL_EDITION
from ..operators import series as S
from ..operators import venues as V
from ..sources.adapters import EVENTS_AS_OF
from . import duck as D
from .registry import query

c = F.col


def now() -> Column:
    return F.lit(EVENTS_AS_OF).cast("timestamp_ntz")


_NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"


@query("last_occurrence", "v_series", sql="SELECT series_id, max(occ_local) AS last, count(DISTINCT occ_local) AS n FROM v_series GROUP BY series_id")
def _(t: DataFrame) -> DataFrame:
    return S.occurrences(t).select("series_id", F.array_max("occ").alias("last"), F.size("occ").cast("long").alias("n"))


@query("display_start", "v_series", sql=f"SELECT series_id, coalesce(min(occ_local) FILTER (occ_local >= {_NOW}), min(occ_local)) AS shown FROM v_series GROUP BY series_id")
def _(t: DataFrame) -> DataFrame:
    return S.occurrences(t).select("series_id", T.display_start(c("occ"), now()).alias("shown"))


@query("occurrence_end", "v_series", sql="SELECT series_id, occ_local, occ_local + INTERVAL 1 MINUTE * greatest(0, floor(value)::INT) AS stop FROM v_series")
def _(t: DataFrame) -> DataFrame:
    return t.select("series_id", "occ_local", F.timestamp_add("MINUTE", F.greatest(F.lit(0), F.floor("value").cast("int")), c("occ_local")).cast("timestamp_ntz").alias("stop"))


@query("occurrences_window", "v_series", sql=f"SELECT series_id, occ_local FROM v_series WHERE occ_local >= {_NOW} AND occ_local < {_NOW} + INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY occ_local, ord) <= 3")
def _(t: DataFrame) -> DataFrame:
    """The next three occurrences of each series within a week: the filter comes before the window."""
    near = t.filter((c("occ_local") >= now()) & (c("occ_local") < now() + F.expr("INTERVAL '7' DAY")))
    return near.withColumn("r", F.row_number().over(W.partitionBy("series_id").orderBy("occ_local", "ord"))).filter("r <= 3").select("series_id", "occ_local")


@query("next_occurrence", "v_series", sql=f"SELECT series_id, min(occ_local) AS next, arg_min(ord, (occ_local, ord)) AS ord FROM v_series WHERE occ_local >= {_NOW} GROUP BY series_id")
def _(t: DataFrame) -> DataFrame:
    m = F.min(F.struct("occ_local", "ord"))
    return t.filter(c("occ_local") >= now()).groupBy("series_id").agg(m.alias("m")).select("series_id", c("m.occ_local").alias("next"), "m.ord")


@query("apply_filters", "v_series", sql=f"""SELECT series_id FROM v_series GROUP BY series_id, event_type HAVING event_type IN ('click', 'purchase', 'view')
  AND bool_or(occ_local >= {_NOW} AND occ_local < {_NOW} + INTERVAL 5 DAY) AND bool_or(dayofweek(occ_local) IN (5, 6))""")
def _(t: DataFrame) -> DataFrame:
    """Any style, any occurrence in the range, any on a chosen weekday."""
    return S.filtered(t, ["click", "purchase", "view"], [5, 6], now(), now() + F.expr("INTERVAL '5' DAY"))


@query("feed_by_day", "v_series", sql=f"""SELECT occ_local::DATE::VARCHAR AS day, {D.day_name('occ_local')} AS weekday, count(*) AS n, count(DISTINCT series_id) AS series, min(occ_local) AS first
  FROM v_series WHERE occ_local >= {_NOW} GROUP BY occ_local::DATE, 2""")
def _(t: DataFrame) -> DataFrame:
    """What takes place on each day from as_of on."""
    day = F.to_date("occ_local")
    out = t.filter(c("occ_local") >= now()).groupBy(day.alias("d")).agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("series"), F.min("occ_local").alias("first"))
    return out.select(c("d").cast("string").alias("day"), T.weekday_name(c("d")).alias("weekday"), "n", "series", "first")


@query("series_collapse", "v_series", sql=f"""SELECT series_id, coalesce(min(occ_local) FILTER (occ_local >= {_NOW}), min(occ_local)) AS start, max(occ_local) AS last, count(DISTINCT occ_local) AS n,
  arg_min(source, ord) AS source, max(value) AS value FROM v_series GROUP BY series_id""")
def _(t: DataFrame) -> DataFrame:
    """Dates of one series in one row; the first row gives what isn't a date."""
    g = t.groupBy("series_id").agg(F.collect_set("occ_local").alias("occ"), F.min_by("source", "ord").alias("source"), F.max("value").alias("value"))
    return g.select("series_id", T.display_start(c("occ"), now()).alias("start"), F.array_max("occ").alias("last"), F.size("occ").cast("long").alias("n"), "source", "value")


@query("series_url", "v_series", sql=f"""WITH u AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'https://www.facebook.com/events/' ELSE 'https://h.example/' END || ord::VARCHAR AS url FROM v_series),
n AS (SELECT series_id AS s, min(occ_local) AS nx FROM v_series WHERE occ_local >= {_NOW} GROUP BY 1)
SELECT series_id, arg_min(url, ({D.rank('url')}, (occ_local IS DISTINCT FROM nx)::INT, ord)) AS url FROM u LEFT JOIN n ON s = series_id GROUP BY series_id""")
def _(t: DataFrame) -> DataFrame:
    """The fittest link, of equals that of the next date."""
    url = F.concat(F.when(c("ord") % 3 == 0, "https://www.facebook.com/events/").otherwise("https://h.example/"), c("ord").cast("string"))
    return S.series_urls(t.withColumn("url", url), now())


@query("median_gap", "v_series", sql="""WITH d AS (SELECT DISTINCT series_id, occ_local::DATE AS d FROM v_series), g AS (SELECT series_id, date_diff('day', lag(d) OVER (PARTITION BY series_id ORDER BY d), d) AS gap FROM d)
SELECT series_id, median(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY series_id""")
def _(t: DataFrame) -> DataFrame:
    """The median of the days between a series' dates; a series of one date has no gap and no row."""
    return S.gaps(t).filter("gap is not null").groupBy("series_id").agg(F.percentile("gap", 0.5).alias("gap"))


@query("recurrence_label", "v_series", sql=f"""WITH d AS (SELECT DISTINCT series_id, occ_local::DATE AS d FROM v_series), g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY series_id ORDER BY d), d) AS gap FROM d)
SELECT series_id, CASE WHEN count(*) < 2 THEN 'once' WHEN count(DISTINCT dayofweek(d)) > 1 THEN 'various days'
  WHEN count(DISTINCT (day(d) + 6) // 7) = 1 AND median(gap) BETWEEN 24 AND 35 THEN 'monthly on ' || min({D.day_name('d')}) WHEN median(gap) BETWEEN 6 AND 8 THEN 'weekly on ' || min({D.day_name('d')})
  WHEN median(gap) BETWEEN 13 AND 15 THEN 'every other ' || min({D.day_name('d')}) ELSE min({D.day_name('d')}) || 's' END AS label FROM g GROUP BY series_id""")
def _(t: DataFrame) -> DataFrame:
    return S.labels(t)


@query("roll_forward", "v_series", sql=f"""WITH s AS (SELECT series_id, min(occ_local) AS start, max(occ_local) AS last, min(occ_local) FILTER (occ_local >= {_NOW}) AS nx FROM v_series GROUP BY series_id)
SELECT series_id, start AS was, coalesce(nx, start) AS start, coalesce(nx, start) + INTERVAL 3 HOUR AS stop FROM s WHERE start < {_NOW}""")
def _(t: DataFrame) -> DataFrame:
    """A stale start moves to the next occurrence; the end moves by as much."""
    s = S.occurrences(t).select("series_id", F.array_min("occ").alias("was"), T.display_start(c("occ"), now()).alias("start")).filter(c("was") < now())
    return s.select("series_id", "was", "start", (c("start") + F.expr("INTERVAL '3' HOUR")).alias("stop"))


@query("series_group", "v_listing", sql=f"""WITH k AS (SELECT *, {D.norm('name')} AS norm, dayofweek(start_local) AS dow, hour(start_local) AS h FROM v_listing WHERE NOT recurring)
SELECT norm, location, dow, h, count(*) AS n, min(start_local) AS start, max(start_local) AS last, arg_min(url, (start_local, ord)) AS url FROM k GROUP BY norm, location, dow, h HAVING count(*) >= 2""")
def _(t: DataFrame) -> DataFrame:
    """Copies of one night (name, place, weekday, clock) become one row with its dates; two at least."""
    return S.nights(t)


@query("series_leaders", "v_listing", "v_source", "v_venue")
def _(t: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    """Over what is published: the venues with regular nights, then the active rows of reliable sources."""
    active = t.filter("pool = 'active'").join(s.filter("unreliable").select("source"), "source", "left_anti")
    active = active.select("id", "ord", T.weekday(c("start_local")).cast("int").alias("dow"), F.lit(False).alias("hub"), "location", "name")
    hubs = v.filter("not coalesce(approximate, false)").select("id", (c("pos") - F.lit(1 << 60)).alias("ord"), c("dow").cast("int").alias("dow"), F.lit(True).alias("hub"), "location", "name")
    return S.leaders(hubs.unionByName(active))


@query("scrape_health", "v_series", sql="""SELECT source, count(*) AS raw, count(*) FILTER (value > 50) AS kept, CASE WHEN count(*) = 0 THEN 'skipped' WHEN count(*) FILTER (value > 50) = 0 THEN 'structure_missing'
  WHEN count(*) FILTER (event_type = 'error') > count(*) / 2 THEN 'fetch_error' ELSE 'ok' END AS health FROM v_series GROUP BY source""")
def _(t: DataFrame) -> DataFrame:
    kept, failed = F.count_if(c("value") > 50), F.count_if(c("event_type") == "error")
    g = t.groupBy("source").agg(F.count("*").alias("raw"), kept.alias("kept"), failed.alias("failed"))
    return g.select("source", "raw", "kept", F.when(c("kept") == 0, "structure_missing").when(c("failed") > c("raw") / 2, "fetch_error").otherwise("ok").alias("health"))


@query("health_daily", "v_series", sql="SELECT source, date_trunc('day', occ_local)::TIMESTAMP AS day, count(*) AS n FROM v_series GROUP BY 1, 2")
def _(t: DataFrame) -> DataFrame:
    """The batch form of the stream of source counts: tumbling days."""
    g = t.groupBy("source", F.window("occ_local", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return g.select("source", c("w.start").alias("day"), "n")


@query("signal_explode", "v_series", sql="""SELECT source, occ_local::DATE::VARCHAR AS day, 'flyer' AS kind, event_type AS text FROM v_series
  UNION ALL SELECT source, (occ_local::DATE + 1)::VARCHAR, 'album', event_type FROM v_series""")
def _(t: DataFrame) -> DataFrame:
    """Dates of posts as rows: source, day, text."""
    kinds = F.array(F.struct(F.lit("flyer").alias("kind"), F.to_date("occ_local").alias("day")), F.struct(F.lit("album").alias("kind"), F.date_add(F.to_date("occ_local"), 1).alias("day")))
    return t.select("source", F.col("event_type").alias("text"), F.inline(kinds)).select("source", c("day").cast("string").alias("day"), "kind", "text")


@query("signal_match", "v_series", sql="""WITH s AS (SELECT ord AS sid, source, occ_local::DATE AS d, event_type FROM v_series),
m AS (SELECT sid, e.ord, CASE WHEN s.source = e.source AND s.event_type = e.event_type THEN 1 WHEN s.source = e.source THEN 2 ELSE 3 END AS strength
  FROM s JOIN v_series e ON e.occ_local::DATE = s.d AND e.ord <> sid AND (s.source = e.source OR (s.event_type = e.event_type)))
SELECT s.sid, b.ord, b.strength FROM s LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sid ORDER BY strength, ord) = 1) b ON b.sid = s.sid""")
def _(t: DataFrame) -> DataFrame:
    """Each dated signal to the best event of its day: of its source and kind, of its source, of its kind; none is an open issue.

    Of each group the first two events are enough: the second is for the signal that is the first itself.
    """
    s = t.select(c("ord").alias("sid"), "source", F.to_date("occ_local").alias("d"), "event_type")
    out = s
    for strength, by in enumerate((["source", "d", "event_type"], ["source", "d"], ["d", "event_type"]), 1):
        first = s.groupBy(*by).agg(F.min("sid").alias("one"))
        second = s.join(first, by).filter("sid <> one").groupBy(*by).agg(F.min("sid").alias("two"))
        pair = first.join(second, by, "left").select(*by, F.array("one", "two").alias(f"m{strength}"))
        out = out.join(pair, by, "left")
    other = lambda k: F.when(c("sid") == c(f"m{k}")[0], c(f"m{k}")[1]).otherwise(c(f"m{k}")[0])
    best = F.coalesce(*(F.when(other(k).isNotNull(), F.struct(other(k).alias("ord"), F.lit(k).alias("strength"))) for k in (1, 2, 3)))
    return out.select("sid", best.alias("m")).select("sid", "m.ord", "m.strength")


_SPAN = ("1998-06-15", "1998-08-10")
_ADMIT = f"""d AS (SELECT v.*, unnest(generate_series(DATE '{_SPAN[0]}', DATE '{_SPAN[1]}', INTERVAL 1 DAY))::DATE AS d FROM v_venue v),
w AS (SELECT * FROM d WHERE dayofweek(d) = dow AND (starts IS NULL OR d >= starts) AND (until_date IS NULL OR d <= until_date)
  AND CASE WHEN regexp_matches(note, '(\\d)(?:st|nd|rd|th)\\s+\\w+day') THEN (day(d) + 6) // 7 = regexp_extract(note, '(\\d)(?:st|nd|rd|th)', 1)::INT
    WHEN contains(note, 'every other') THEN (floor(date_diff('day', DATE '2026-01-02', d) / 7.0)::INT % 2 + 2) % 2 = 0 ELSE true END)"""


@query("venue_expand", "v_venue", sql=f"WITH {_ADMIT} SELECT id, d::VARCHAR AS day FROM w")
def _(v: DataFrame) -> DataFrame:
    """Every date of the weekly schedules in the span."""
    return V.expand(v, *_SPAN).select("id", c("day").cast("string").alias("day"))


_HIT = f"""WITH {_ADMIT}, h AS (SELECT l.id, l.ord, l.start_local, l.end_local, l.name AS lname, w.id AS hub, w.pos, w.name AS hname, w.time_text, w.approximate FROM v_listing l JOIN w ON w.d = l.start_local::DATE AND w.location = l.location)"""


@query("hub_collisions", "v_listing", "v_venue", sql=f"{_HIT} SELECT id, arg_min(hub, pos) AS hub FROM h GROUP BY id")
def _(t: DataFrame, v: DataFrame) -> DataFrame:
    """Listings on a night that a venue has a regular event on; the first venue in order."""
    return V.collisions(t, V.expand(v, *_SPAN)).groupBy("id").agg(F.min_by("hub", "pos").alias("hub"))


_CLOCK = r"""CASE WHEN regexp_matches({x}, '\d{1,2}:\d{2} (AM|PM)') THEN (regexp_extract({x}, '(\d{1,2}):', 1)::INT % 12 + CASE WHEN {x} LIKE '%PM' THEN 12 ELSE 0 END) * 60 + regexp_extract({x}, ':(\d{2})', 1)::INT END"""
_OVER = f"""{_HIT}, m AS (SELECT *, {_CLOCK.replace('{x}', "split_part(time_text, ' - ', 1)")} AS a, {_CLOCK.replace('{x}', "split_part(time_text, ' - ', 2)")} AS b FROM h),
o AS (SELECT *, CASE WHEN b IS NOT NULL THEN (hour(start_local) * 60 < CASE WHEN b <= a THEN b + 1440 ELSE b END) AND
  a < hour(start_local) * 60 + CASE WHEN end_local > start_local THEN date_diff('minute', start_local, end_local) ELSE 180 END END AS meets FROM m)"""


@query("window_overlap", "v_listing", "v_venue", sql=f"{_OVER} SELECT id, hub, meets FROM o")
def _(t: DataFrame, v: DataFrame) -> DataFrame:
    """Half-open times of the night; a venue past midnight runs on, a listing without end lasts three hours, unknown clocks give null."""
    return V.overlapping(t, V.expand(v, *_SPAN))


@query("hub_verdicts", "v_listing", "v_venue", sql=f"""{_OVER}, f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)
SELECT id, hub, CASE WHEN {D.has(D.norm('lname'), SPECIAL_EDITION)} THEN 'keep_special' WHEN meets AND len(list_intersect({D.words(D.norm('lname'))}, {D.words(D.norm('hname'))})) > 0 THEN 'fold' ELSE 'keep' END AS verdict FROM f""")
def _(t: DataFrame, v: DataFrame) -> DataFrame:
    return V.verdicts(V.overlaps(V.collisions(t, V.first_nights(V.expand(v, *_SPAN))))).select("id", "hub", "verdict")


@query("irregular_cover", "v_listing", "v_venue", sql="""SELECT v.id, count(l.id) > 0 AS confirmed, arg_min(l.url, (l.start_local, l.ord)) AS url FROM v_venue v LEFT JOIN v_listing l ON l.location = v.location
  AND l.start_local >= TIMESTAMP '1998-06-15 00:00:00' AND l.pool = 'active' WHERE v.approximate GROUP BY v.id""")
def _(t: DataFrame, v: DataFrame) -> DataFrame:
    """A venue without fixed dates is confirmed by a future listing there, and borrows its link."""
    future = t.filter((c("start_local") >= F.lit("1998-06-15").cast("timestamp_ntz")) & (c("pool") == "active"))
    per = future.groupBy("location").agg(F.min(F.struct("start_local", "ord", "url")).alias("m"))
    return v.filter("approximate").join(per, "location", "left").select("id", c("m").isNotNull().alias("confirmed"), c("m.url").alias("url"))


@query("weekday_runs", "v_venue", sql=f"""WITH d AS (SELECT DISTINCT location, dow FROM v_venue), g AS (SELECT *, dow - row_number() OVER (PARTITION BY location ORDER BY dow) AS grp FROM d),
r AS (SELECT location, min(dow) AS a, max(dow) AS b FROM g GROUP BY location, grp) SELECT location, string_agg(CASE WHEN a = b THEN {D.array(T.DAYS)}[a + 1][1:3] ELSE {D.array(T.DAYS)}[a + 1][1:3] || '–' || {D.array(T.DAYS)}[b + 1][1:3] END, ', ' ORDER BY a) AS days FROM r GROUP BY location""")
def _(v: DataFrame) -> DataFrame:
    """Days of a place in runs: Mon–Wed, Fri."""
    return V.day_runs(v)


@query("validate_venues", "v_venue", sql="""SELECT id, array_to_string([x for x in [CASE WHEN time_text = 'late' THEN 'bad time' END, CASE WHEN until_date IS NOT NULL AND starts IS NOT NULL AND until_date < starts THEN 'bounds' END,
  CASE WHEN note = '' AND approximate THEN 'approximate without note' END] if x IS NOT NULL], '; ') AS problems FROM v_venue""")
def _(v: DataFrame) -> DataFrame:
    return V.problems(v)
