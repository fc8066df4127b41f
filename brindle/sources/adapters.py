"""Listing-shaped views over the star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Local wall clock at which order-based queries look at the data, and that of event-based ones.
AS_OF, EVENTS_AS_OF = "1998-06-15 12:00:00", "2024-01-15 00:00:00"

_HALL = "'Hall ' || CAST({k} % 40 AS STRING) || ', ' || CAST(100 + {k} % 40 AS STRING) || ' Main Street, Boston, MA'"

VIEWS: dict[str, str] = {
    "v_listing": f"""
SELECT o_orderkey AS ord, 'L' || CAST(o_orderkey AS STRING) AS id,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'archive' ELSE 'pending' END AS pool,
  'src' || CAST(o_orderkey % 25 AS STRING) AS source,
  CASE (o_orderkey * 7 + o_custkey) % 12 WHEN 0 THEN 'Salsa Social' WHEN 1 THEN 'Bachata Night Vol. 3' WHEN 2 THEN 'Harbor Salsa Friday 9/12'
    WHEN 3 THEN 'Rooftop Party (ft DJ Luna)' WHEN 4 THEN 'Zouk Workshop' WHEN 5 THEN 'Annual Harbor Festival' WHEN 6 THEN 'Latin Night #4'
    WHEN 7 THEN 'Kizz Thursday Social' WHEN 8 THEN 'Kiz Thursday Social' WHEN 9 THEN 'Tambo Social, Friday Oct 9th' WHEN 10 THEN 'Craft Fair'
    ELSE 'Harbor Salsa Anniversary' END AS name,
  o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) AS start_local,
  o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24 + o_orderkey % 9 - 1) AS end_local,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE {_HALL.format(k="o_custkey")} END AS location,
  CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE 42.36e0 + (o_custkey % 40 - 20) * 0.05e0 END AS lat,
  CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE -71.06e0 + (o_custkey % 25 - 12) * 0.05e0 END AS lng,
  CASE o_orderkey % 5 WHEN 0 THEN '$10 at the door' WHEN 1 THEN 'Free' WHEN 2 THEN '$15-20' WHEN 3 THEN '' ELSE NULL END AS cost,
  'https://www.host' || CAST(o_custkey % 50 AS STRING) || '.example/e/' || CAST(o_orderkey % 5000 AS STRING) || '/' AS url,
  o_orderkey % 3 = 0 AS recurring
FROM {{orders}}""",
    "v_source": """
SELECT 'src' || CAST(n_nationkey AS STRING) AS source, n_name AS organizer, n_nationkey AS source_rank, (n_nationkey * 13) % 101 AS noise,
  n_nationkey % 2 = 0 AS trusted, n_nationkey % 7 = 6 AS unreliable FROM {nation}""",
    "v_venue": f"""
SELECT s_suppkey AS pos, 'V' || CAST(s_suppkey AS STRING) AS id,
  CASE s_suppkey % 3 WHEN 0 THEN 'Harbor Salsa' WHEN 1 THEN 'Tambo Social' ELSE 'Rooftop Club' END AS name, {_HALL.format(k="s_suppkey")} AS location,
  CASE s_suppkey % 7 WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday'
    ELSE 'Saturday' END AS day_of_week, s_suppkey % 7 AS dow,
  CASE s_suppkey % 5 WHEN 0 THEN '9:00 PM - 2:00 AM' WHEN 1 THEN '8:00 PM - 11:30 PM' WHEN 2 THEN '12:00 AM - 3:00 AM' WHEN 3 THEN 'late'
    ELSE '1:00 PM - 5:00 PM' END AS time_text,
  CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1st weekday of each month' WHEN 2 THEN 'every other week' ELSE '3rd weekday' END AS note,
  CASE WHEN s_suppkey % 6 = 0 THEN DATE '1998-01-01' END AS starts, CASE WHEN s_suppkey % 6 = 1 THEN DATE '1998-12-31' END AS until_date,
  s_suppkey % 8 = 7 AS approximate FROM {{supplier}}""",
    "v_series": """
SELECT CAST(user_id AS STRING) || '|' || event_type AS series_id, user_id, event_type, event_id AS ord,
  'src' || CAST(user_id % 25 AS STRING) AS source, ts AS occ_local, value FROM {events}""",
    "v_claim": """
SELECT l.l_orderkey AS listing_ord, l.l_linenumber AS claim_no, l.l_partkey AS claim_id,
  CASE l.l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN o.o_orderdate + INTERVAL '4' HOUR WHEN 2 THEN o.o_orderdate + INTERVAL '5' HOUR
    WHEN 3 THEN o.o_orderdate + INTERVAL '1' DAY ELSE o.o_orderdate END + INTERVAL '1' HOUR * (o.o_orderkey % 24) AS claim_local,
  CASE l.l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Hall ' || CAST(o.o_custkey % 40 AS STRING) ELSE 'Hall ' || CAST(l.l_suppkey % 40 AS STRING) END AS claim_place,
  l.l_linenumber = 4 AS city_level FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "v_link": r"""
SELECT page_id, url, CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN NULL WHEN 4 THEN 410 ELSE 200 END AS status,
  CASE page_id % 10 WHEN 3 THEN CASE page_id % 3 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'Timeout' END END AS error,
  regexp_extract(lower(url), '^https?://(?:www[.])?([^/]+)', 1) AS host, html FROM {pages}""",
    "v_registry": f"""
SELECT 'old-' || CAST(o_orderkey AS STRING) AS slug,
  CASE o_orderkey % 4 WHEN 1 THEN 'L' || CAST(o_orderkey AS STRING) ELSE 'gone' || CAST(o_orderkey AS STRING) END AS id,
  CASE o_orderkey % 4 WHEN 2 THEN 'Salsa Social' WHEN 3 THEN 'Annual Harbor Fair' ELSE 'Harbor Salsa Reunion Festival' END AS name, {_HALL.format(k="o_custkey")} AS location,
  o_orderdate AS start_local, 42.36e0 + (o_custkey % 40 - 20) * 0.05e0 AS lat, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE -71.06e0 + (o_custkey % 25 - 12) * 0.05e0 END AS lng
FROM {{orders}} WHERE o_orderkey % 4 <> 0""",
    "v_decision": """
SELECT conv_id AS item, turn AS seq, role AS actor,
  CASE length(text) % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'different' WHEN 2 THEN 'approve' ELSE 'skip' END AS choice FROM {conversations}""",
    "v_text": "SELECT d.doc_id, d.text, d.source, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "v_name": """
SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN substring(p_name, 1, length(p_name) - 1) ELSE p_name END AS variant FROM {part}""",
}

#: Listings that share their organizer's address; those that recur list further nights.
VIEWS["v_dated"] = f"""
SELECT v.ord, v.id, v.pool, v.source, v.name, v.start_local, v.end_local, v.location, v.lat, v.lng, v.cost, 'https://club.example/c' || CAST(o.o_custkey AS STRING) AS url, v.recurring, r.recurrences
FROM ({VIEWS["v_listing"].strip()}) v JOIN {{orders}} o ON o.o_orderkey = v.ord
  LEFT JOIN (SELECT l_orderkey, array_agg(l_shipdate + INTERVAL '1' HOUR * (l_orderkey % 24)) AS recurrences FROM {{lineitem}} GROUP BY l_orderkey) r ON r.l_orderkey = v.ord AND v.recurring"""

#: Copies of listings, eight to a group, some of one id; with what merging has to choose from.
VIEWS["v_copy"] = f"""
SELECT 'G' || CAST(CAST(floor(ord / 8) AS BIGINT) AS STRING) AS g, 'I' || CAST(ord - CASE WHEN ord % 4 = 1 THEN 1 ELSE 0 END AS STRING) AS id, ord, CASE WHEN ord % 5 = 0 THEN NULL ELSE 'src' || CAST(ord % 2 AS STRING) END AS source,
  (ord * 5) % 3 AS source_rank, name, CASE WHEN ord % 11 = 0 THEN NULL ELSE start_local END AS start_local, end_local, recurring, recurrences, CASE WHEN ord % 10 = 3 THEN 'weekly ' || id END AS schedule, location,
  CASE WHEN ord % 41 = 0 THEN 'Annex of ' || id END AS location_override, lat, CASE WHEN ord % 6 = 1 THEN NULL ELSE lng END AS lng, CASE ord % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'about ' || id END AS description, cost,
  CASE ord % 3 WHEN 0 THEN split('other', ',') WHEN 1 THEN NULL ELSE split('salsa,' || id, ',') END AS styles, CASE WHEN ord % 50 = 7 THEN true END AS special, CASE WHEN ord % 30 = 2 THEN 'keep ' || id END AS ruling,
  CASE WHEN ord % 6 = 5 THEN start_local END AS verified_at, CASE WHEN ord % 6 = 4 THEN 'confirmed' END AS verified_status, CASE WHEN ord % 8 = 6 THEN 'seen by ' || id END AS verified_note,
  CASE ord % 4 WHEN 0 THEN 'https://www.facebook.com/events/' || id WHEN 1 THEN '' ELSE url END AS url, split(url || '/more,https://club' || CAST(ord % 2 AS STRING) || '.example/' || id, ',') AS urls,
  CASE WHEN ord % 9 = 0 THEN split(url || ',https://www.facebook.com/events/' || id || ',https://club0.example/' || id, ',') END AS dropped_urls, CASE WHEN ord % 37 = 0 THEN start_local + INTERVAL '1' HOUR END AS fixed_start, CASE WHEN ord % 74 = 0 THEN end_local + INTERVAL '2' HOUR END AS fixed_end
FROM ({VIEWS["v_dated"].strip()})"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of a folder."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front of it."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[v])})" for v in named]
    sql = sql.strip()
    rest = sql[4:].strip() if sql.upper().startswith("WITH") else None
    if not ctes:
        return sql
    head = "WITH"
    if rest and rest.upper().startswith("RECURSIVE"):
        head, rest = "WITH RECURSIVE", rest[9:].strip()
    return f"{head} {', '.join(ctes)}, {rest}" if rest else f"{head} {', '.join(ctes)} {sql}"
