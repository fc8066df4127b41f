"""Queries of readers and of history: search by an index, totals of all levels, past snapshots."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timefn as T
from ..operators import audit as A
from ..operators import history as H
from ..operators import index as I
from . import duck as D
from .registry import query

c = F.col
L = "v_listing"
_FOUND = " + ".join(f"CASE WHEN {test} THEN {w} ELSE 0 END" for test, w in [(f"contains({f}, t)", I.FIELDS[f]) for f in ("name", "location", "organizer", "styles", "text")] + [("starts_with(day, t)", I.FIELDS["day"])])


def _records(rows: DataFrame, s: DataFrame) -> DataFrame:
    """(Here what a listing costs stands for its text.)"""
    named = rows.join(s.select("source", "organizer"), "source", "left")
    return I.search_record(named.select("ord", "id", "name", "location", "organizer", X.detect_styles(c("name")).alias("styles"), "day", c("cost").alias("text")))


@query("search_index", L, "v_source", sql=f"""WITH f AS (SELECT ord, id, pool, lower(name) AS name, lower(coalesce(location, '')) AS location, lower(coalesce(organizer, '')) AS organizer, array_to_string({D.styles('name')}, ' ') AS styles, lower({D.day_name('start_local')}) AS day, lower(coalesce(cost, '')) AS text
  FROM v_listing LEFT JOIN v_source USING (source)), q AS (SELECT DISTINCT string_split(name, ' ')[1] || ' ' || day[1:3] AS query FROM f WHERE pool = 'archive' UNION SELECT organizer FROM v_source UNION SELECT name FROM v_listing),
w AS (SELECT query, unnest([x for x in string_split_regex(lower(query), '\\s+') if x <> '']) AS t FROM q WHERE length(query) >= 2), n AS (SELECT query, count(*) AS tokens FROM w GROUP BY query), k AS (SELECT DISTINCT t FROM w),
h AS (SELECT ord, id, t, {_FOUND} AS weight FROM f, k WHERE pool = 'active'), p AS (SELECT query, ord, id, count(*) AS hits, sum(weight) AS score FROM w JOIN h USING (t) WHERE weight > 0 GROUP BY query, ord, id)
SELECT query, id, score FROM p JOIN n USING (query) WHERE hits = tokens QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) <= 8""")
def _(t: DataFrame, s: DataFrame) -> DataFrame:
    """The eight best live listings of each search, by all six fields. (Here the searches are archived titles' first words with a day's beginning, organizers and titles.)"""
    first = F.concat_ws(" ", F.split(F.lower("name"), " ")[0], F.substring(F.lower(T.weekday_name(c("start_local"))), 1, 3))
    searches = t.filter("pool = 'archive'").select(first.alias("query")).union(s.select("organizer")).union(t.select("name")).distinct()
    rows = t.filter("pool = 'active'").select("ord", "id", "name", "location", "source", "cost", T.weekday_name(c("start_local")).alias("day"))
    return I.search_rows(rows, searches, lambda some: _records(some, s)).select("query", "id", "score")


_SETS = [["check_name", "source", "pool"], ["check_name", "source"], ["check_name", "pool"], ["check_name"], []]
_CHECKS = {"no_place": "location IS NULL", "no_point": "lat IS NULL OR lng IS NULL", "dead_hour": "hour(start_local) BETWEEN 1 AND 8", "ends_first": "end_local < start_local", "no_cost": "coalesce(cost, '') = ''"}


@query("check_totals", L, sql=f"""WITH r AS ({" UNION ALL ".join(f"SELECT '{k}' AS check_name, source, pool, ord, id FROM v_listing WHERE {test}" for k, test in _CHECKS.items())})
SELECT GROUPING_ID(check_name, source, pool) AS level, check_name, source, pool, count(*) AS n, array_to_string(list(id ORDER BY ord, check_name)[1:5], ',') AS examples FROM (SELECT * FROM r) GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in _SETS)})""")
def _(t: DataFrame) -> DataFrame:
    """Findings per check, source and pool, with their totals and first rows of each."""
    found = F.array_compact(F.array(*(F.when(F.expr(test), F.lit(k)) for k, test in _CHECKS.items())))
    return A.totals(t.select("ord", "id", "source", "pool", F.explode(found).alias("check_name")), _SETS).withColumn("examples", F.array_join("examples", ","))


_SNAPS = """s AS (SELECT 'v' || v::VARCHAR AS version, 'page-' || ord::VARCHAR AS slug, id, CASE WHEN ord % 7 < v THEN name || ' (moved)' ELSE name END AS name, location, start_local, lat, lng
  FROM v_listing, unnest([1, 2, 3, 4]) AS u(v) WHERE pool <> 'pending' AND (ord // 3 + v * v) % 4 <> 0), nv AS (SELECT version, row_number() OVER (ORDER BY version) AS no, lead(version) OVER (ORDER BY version) AS next_version FROM (SELECT DISTINCT version FROM s)),
o AS (SELECT s.*, no, next_version, lag(no) OVER w AS b, lead(no) OVER w AS a, lag(name) OVER w AS bn FROM s JOIN nv USING (version) WINDOW w AS (PARTITION BY slug ORDER BY no))"""


def _snapshots(t: DataFrame) -> DataFrame:
    """(Here four snapshots of live and archived listings, each without a fourth of them; titles change from one to the next.)"""
    rows = t.filter("pool <> 'pending'").withColumn("v", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).filter(F.expr("(ord div 3 + v * v) % 4 <> 0"))
    name = F.when(c("ord") % 7 < c("v"), F.concat("name", F.lit(" (moved)"))).otherwise(c("name"))
    return rows.select(F.concat(F.lit("v"), c("v").cast("string")).alias("version"), F.concat(F.lit("page-"), c("ord").cast("string")).alias("slug"), "id", name.alias("name"), "location", "start_local", "lat", "lng")


@query("snapshot_changes", L, sql=f"""WITH {_SNAPS} SELECT version, slug, CASE WHEN b IS NULL THEN 'added' WHEN b < no - 1 THEN 'returned' ELSE 'changed' END AS change FROM o WHERE b IS NULL OR b < no - 1 OR bn <> name
UNION ALL SELECT next_version, slug, 'retired' FROM o WHERE next_version IS NOT NULL AND coalesce(a > no + 1, true)""")
def _(t: DataFrame) -> DataFrame:
    return H.snapshot_changes(_snapshots(t))


@query("slug_backfill", L, sql=f"""WITH {_SNAPS} SELECT slug, arg_min(id, no) AS id, arg_min(name, no) AS name, min(version) AS first_seen, max(version) AS last_seen, CASE WHEN max(no) < 4 THEN 'v' || (max(no) + 1)::VARCHAR END AS retired_at, count(*) FILTER (b < no - 1) AS returns
  FROM o WHERE slug NOT IN (SELECT 'page-' || ord::VARCHAR FROM v_listing WHERE ord % 6 = 0) GROUP BY slug UNION ALL SELECT 'page-' || ord::VARCHAR, id, name, 'register', 'register', NULL, NULL FROM v_listing WHERE ord % 6 = 0""")
def _(t: DataFrame) -> DataFrame:
    """The register filled from past snapshots. (Here it knows the rows whose number divides by 6.)"""
    known = t.filter("ord % 6 = 0").select(F.concat(F.lit("page-"), c("ord").cast("string")).alias("slug"), "id", "name", "location", "start_local", "lat", "lng", F.lit("register").alias("first_seen"), F.lit("register").alias("last_seen"))
    return H.backfill(known, _snapshots(t)).select("slug", "id", "name", "first_seen", "last_seen", "retired_at", "returns")
