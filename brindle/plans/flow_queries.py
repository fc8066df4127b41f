"""Queries of the flow from new rows to the published feed, its audits and its readers."""

# ruff: noqa: E501
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as X
from ..functions import timefn as T
from ..functions.names import normalize_name
from ..operators import audit as A
from ..operators import copies as CP
from ..operators import lifecycle as LC
from ..operators import match as M
from ..operators import publish as PB
from ..operators import search as Q
from ..sources.adapters import AS_OF
from . import duck as D
from .registry import query

c = F.col


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


L = "v_listing"
_NOW = f"TIMESTAMP '{AS_OF}'"


@query("pool_counts", L, sql="SELECT pool, count(*) AS n, count(location) AS placed FROM v_listing GROUP BY pool")
def _(t: DataFrame) -> DataFrame:
    return t.groupBy("pool").agg(F.count("*").alias("n"), F.count("location").alias("placed"))


@query("scrape_union", L, sql="SELECT source, count(*) AS n, max(start_local) AS last FROM v_listing WHERE pool <> 'archive' GROUP BY source")
def _(t: DataFrame) -> DataFrame:
    return t.filter("pool = 'active'").unionByName(t.filter("pool = 'pending'")).groupBy("source").agg(F.count("*").alias("n"), F.max("start_local").alias("last"))


@query("upcoming_slice", L, sql=f"SELECT id, name, start_local FROM v_listing WHERE pool = 'active' AND start_local >= {_NOW}")
def _(t: DataFrame) -> DataFrame:
    return t.filter((c("pool") == "active") & (c("start_local") >= now())).select("id", "name", "start_local")


_BASE = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')[1:60]"
_SLUGS = f"s AS (SELECT id, pool, recurring, start_local, {_BASE} AS base, {_BASE} || '-' || lower(id[1:8]) AS first FROM v_listing), u AS (SELECT *, CASE WHEN id = min(id) OVER (PARTITION BY first) THEN first ELSE base || '-' || md5(id)[1:8] END AS slug FROM s)"


@query("slug_collisions", L, sql=f"""WITH s AS (SELECT 'listing-' || id AS id, ord, pool, {_BASE} AS base FROM v_listing), o AS (SELECT base, arg_max(id, ord) AS owner FROM s WHERE pool = 'archive' AND ord % 2 = 1 GROUP BY base),
k AS (SELECT s.id, base, coalesce(owner, min(id) OVER (PARTITION BY base)) AS keeper FROM s LEFT JOIN o USING (base)) SELECT id, base || '-' || CASE WHEN id = keeper THEN 'listing-' ELSE md5(id)[1:8] END AS slug FROM k""")
def _(t: DataFrame) -> DataFrame:
    """Ids that share their first eight characters. The register knows each slug by the last odd archived row."""
    rows = t.withColumn("id", F.concat(F.lit("listing-"), "id"))
    owners = rows.filter("pool = 'archive' and ord % 2 = 1").groupBy(F.concat(PB.slug_base(c("name")), F.lit("-listing-")).alias("slug")).agg(F.max_by("id", "ord").alias("id"))
    return PB.unique_slugs(rows, owners)


@query("sitemap_urls", L, sql=f"""WITH {_SLUGS} SELECT DISTINCT 'https://site.example/event/' || slug AS loc, CASE WHEN recurring THEN 'weekly' ELSE 'monthly' END AS changefreq, CASE WHEN start_local >= {_NOW} THEN 0.8 ELSE 0.4 END::DOUBLE AS priority
  FROM u WHERE pool = 'active' OR recurring""")
def _(t: DataFrame) -> DataFrame:
    rows = t.join(PB.unique_slugs(t), "id").filter((c("pool") == "active") | c("recurring"))
    return rows.select(F.concat(F.lit("https://site.example/event/"), "slug").alias("loc"), F.when(c("recurring"), "weekly").otherwise("monthly").alias("changefreq"), F.when(c("start_local") >= now(), 0.8).otherwise(0.4).alias("priority")).distinct()


@query("page_slugs", L, "v_registry", sql=f"WITH {_SLUGS} SELECT slug FROM u UNION SELECT slug FROM v_registry")
def _(t: DataFrame, r: DataFrame) -> DataFrame:
    return PB.unique_slugs(t).select("slug").union(r.select("slug")).distinct()


@query("slug_diff", L, "v_registry", sql=f"WITH {_SLUGS}, r AS (SELECT 'salsa-social-' || lower(replace(id, 'gone', 'L')[1:8]) AS slug FROM v_registry UNION ALL SELECT slug FROM v_registry WHERE slug LIKE '%7') SELECT DISTINCT slug, 'new' AS kind FROM u WHERE slug NOT IN (SELECT slug FROM r) UNION ALL SELECT DISTINCT slug, 'retired' FROM r WHERE slug NOT IN (SELECT slug FROM u)")
def _(t: DataFrame, r: DataFrame) -> DataFrame:
    now = PB.unique_slugs(t).select("slug")
    was = r.select(F.concat(F.lit("salsa-social-"), F.lower(F.substring(F.replace("id", F.lit("gone"), F.lit("L")), 1, 8))).alias("slug")).union(r.filter("slug like '%7'").select("slug"))
    return now.join(was, "slug", "left_anti").distinct().withColumn("kind", F.lit("new")).union(was.join(now, "slug", "left_anti").distinct().withColumn("kind", F.lit("retired")))


@query("jsonld_export", L, sql=f"""SELECT id, name, strftime(start_local, '%Y-%m-%dT%H:%M') AS start_date, location AS place, try_cast(nullif(regexp_extract(cost, '\\$?\\s*(\\d+(?:\\.\\d{{1,2}})?)', 1), '') AS DOUBLE) AS price
  FROM v_listing WHERE pool = 'active' ORDER BY start_local, id LIMIT 50""")
def _(t: DataFrame) -> DataFrame:
    """The first fifty live rows, as fields of schema.org's Event."""
    top = t.filter("pool = 'active'").orderBy("start_local", "id").limit(50)
    return top.select("id", "name", F.date_format("start_local", "yyyy-MM-dd'T'HH:mm").alias("start_date"), c("location").alias("place"), F.regexp_extract("cost", r"\$?\s*(\d+(?:\.\d{1,2})?)", 1).try_cast("double").alias("price"))


@query("map_features", L, sql="""WITH m AS (SELECT id, name, lat, lng, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY round(lat, 5), round(lng, 5)) AS n FROM v_listing WHERE lat IS NOT NULL AND pool = 'active' WINDOW w AS (PARTITION BY round(lat, 5), round(lng, 5) ORDER BY ord))
SELECT id, name, round(lat + CASE WHEN n > 1 THEN 0.0002 * cos(2 * pi() * i / n) ELSE 0 END, 6) AS lat, round(lng + CASE WHEN n > 1 THEN 0.0002 * sin(2 * pi() * i / n) ELSE 0 END, 6) AS lng, n FROM m""")
def _(t: DataFrame) -> DataFrame:
    return Q.staggered(t.filter("lat is not null and pool = 'active'")).select("id", "name", "lat", "lng", "n")


@query("span_to_recurring", L, sql="""SELECT id, recurring OR date_diff('day', start_local::DATE, stop::DATE) > 14 AS recurring, coalesce(stop, start_local) AS stop FROM (SELECT *, CASE WHEN ord % 5 <> 0 THEN end_local + INTERVAL 1 DAY * (ord % 40) END AS stop FROM v_listing)""")
def _(t: DataFrame) -> DataFrame:
    stop = F.when(c("ord") % 5 != 0, F.timestamp_add("DAY", (c("ord") % 40).cast("int"), c("end_local")).cast("timestamp_ntz"))
    return t.withColumn("stop", stop).select("id", (c("recurring") | (F.datediff("stop", "start_local") > 14)).alias("recurring"), F.coalesce("stop", "start_local").alias("stop"))


@query("make_listing", L, sql=f"""SELECT id, CASE WHEN end_local > start_local THEN end_local ELSE start_local END AS stop, {D.day_name('start_local')} AS day, array_to_string({D.styles('name')}, ',') AS styles,
  coalesce(nullif(cost, ''), CASE WHEN {D.has('name', r'\bfree\b')} THEN 'Free' END) AS cost FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    from ..functions.timefn import weekday_name

    return t.select("id", F.when(c("end_local") > c("start_local"), c("end_local")).otherwise(c("start_local")).alias("stop"), weekday_name(c("start_local")).alias("day"), F.array_join(X.detect_styles(c("name")), ",").alias("styles"), F.coalesce(F.nullif("cost", F.lit("")), X.extract_cost(c("name"))).alias("cost"))


@query("keep_future", L, sql=f"SELECT id FROM v_listing WHERE start_local >= {_NOW} - INTERVAL 1 DAY OR start_local IS NULL")
def _(t: DataFrame) -> DataFrame:
    return t.filter((c("start_local") >= now() - F.expr("INTERVAL '1' DAY")) | c("start_local").isNull()).select("id")


@query("first_per_id", L, sql="SELECT source, url, id FROM v_listing QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY ord) = 1")
def _(t: DataFrame) -> DataFrame:
    return t.groupBy("source", "url").agg(F.min_by("id", "ord").alias("id"))


@query("first_pool", L, sql="SELECT url, arg_min(pool, (CASE pool WHEN 'active' THEN 1 WHEN 'archive' THEN 2 ELSE 3 END, ord)) AS pool, arg_min(id, (CASE pool WHEN 'active' THEN 1 WHEN 'archive' THEN 2 ELSE 3 END, ord)) AS id FROM v_listing GROUP BY url")
def _(t: DataFrame) -> DataFrame:
    order = F.struct(F.when(c("pool") == "active", 1).when(c("pool") == "archive", 2).otherwise(3), "ord")
    return t.groupBy("url").agg(F.min_by(F.struct("pool", "id"), order).alias("m")).select("url", "m.pool", "m.id")


@query("list_filter", L, sql="SELECT id, name FROM v_listing WHERE pool = 'active' AND (contains(lower(name), 'salsa') OR contains(lower(coalesce(location, '')), 'salsa')) ORDER BY ord LIMIT 100")
def _(t: DataFrame) -> DataFrame:
    return Q.listed(t, "active", "salsa", 100).select("id", "name")


@query("text_match", L, sql="SELECT id FROM v_listing WHERE regexp_matches(lower(name), '\\bsalsa\\b') AND contains(lower(name), 'soc')")
def _(t: DataFrame) -> DataFrame:
    """Each token; all but the last as whole words, the last as a beginning."""
    return t.filter(Q.matches("salsa soc", [c("name")])).select("id")


@query("search_rank", L, sql="""WITH s AS (SELECT id, ord, CASE WHEN contains(lower(name), 'harbor') THEN 10 ELSE 0 END + CASE WHEN contains(lower(coalesce(location, '')), 'harbor') THEN 5 ELSE 0 END AS a,
  CASE WHEN contains(lower(name), 'hall 7') THEN 10 ELSE 0 END + CASE WHEN contains(lower(coalesce(location, '')), 'hall') THEN 5 ELSE 0 END AS b FROM v_listing WHERE pool = 'active')
SELECT id, a + b AS score FROM s WHERE a > 0 AND b > 0 ORDER BY a + b DESC, ord LIMIT 8""")
def _(t: DataFrame) -> DataFrame:
    return Q.ranked(t.filter("pool = 'active'"), "harbor hall", 8).select("id", "score")


@query("next_instance", L, sql=f"""WITH n AS (SELECT id, ord, pool, start_local, location, {D.norm('name')} AS norm FROM v_listing)
SELECT a.id, arg_min(b.id, (b.start_local, b.ord)) AS next FROM n a JOIN n b ON a.norm = b.norm AND a.location = b.location AND a.pool = 'archive' AND b.pool = 'active' GROUP BY a.id""")
def _(t: DataFrame) -> DataFrame:
    """The live listing of an archived one's name and place with the earliest start: one row per name and place is joined, not each pair."""
    n = t.select("id", "ord", "pool", "start_local", "location", normalize_name(c("name")).alias("norm"))
    live = n.filter("pool = 'active'").groupBy("norm", "location").agg(F.min_by("id", F.struct("start_local", "ord")).alias("next"))
    return n.filter("pool = 'archive'").join(live, ["norm", "location"]).select("id", "next")


@query("past_instances", L, sql=f"SELECT norm, location, id FROM (SELECT id, ord, location, start_local, {D.norm('name')} AS norm FROM v_listing WHERE pool = 'archive') QUALIFY row_number() OVER (PARTITION BY norm, location ORDER BY start_local DESC, ord) <= 8")
def _(t: DataFrame) -> DataFrame:
    n = t.filter("pool = 'archive'").withColumn("norm", normalize_name(c("name")))
    return n.withColumn("r", F.row_number().over(W.partitionBy("norm", "location").orderBy(F.desc("start_local"), "ord"))).filter("r <= 8").select("norm", "location", "id")


@query("upcoming_topk", L, sql=f"SELECT location, id FROM v_listing WHERE start_local >= {_NOW} QUALIFY row_number() OVER (PARTITION BY location ORDER BY start_local, ord) <= 3")
def _(t: DataFrame) -> DataFrame:
    return t.filter(c("start_local") >= now()).withColumn("r", F.row_number().over(W.partitionBy("location").orderBy("start_local", "ord"))).filter("r <= 3").select("location", "id")


@query("publish_feed", L, "v_source", sql=f"""SELECT id, name, start_local AS start, coalesce(location, '') AS place, organizer, array_to_string({D.styles('name')}, ',') AS styles,
  CASE WHEN trim(cost) = '' OR {D.has('cost', r'\bfree\b')} THEN 0 ELSE try_cast(nullif(regexp_extract(cost, '\\$?\\s*(\\d+(?:\\.\\d{{1,2}})?)', 1), '') AS DOUBLE) END AS price, pool = 'archive' OR start_local < {_NOW} AS archived
  FROM v_listing LEFT JOIN v_source USING (source) WHERE pool IN ('active', 'archive') AND NOT coalesce(unreliable, false)""")
def _(t: DataFrame, s: DataFrame) -> DataFrame:
    return PB.feed(t, s, now())


@query("publish_snapshot", L, "v_venue", "v_source")
def _(t: DataFrame, v: DataFrame, s: DataFrame) -> DataFrame:
    """The whole publish: venues, folding, merging, series, roll-forward, archive, search-only rows, slugs, order."""
    out = PB.compose(t, v, s, now())
    return out.select("id", "name", "start", "stop", "place", "price", "styles", F.size("dates").cast("long").alias("dates"), "members", "archived", "search_only", "slug")


@query("tripwire", L, sql="SELECT a.n AS n_now, b.n AS n_before, b.n >= 20 AND a.n < b.n * 0.7 AS refuse FROM (SELECT count(*) AS n FROM v_listing WHERE pool = 'active') a, (SELECT count(*) AS n FROM v_listing) b")
def _(t: DataFrame) -> DataFrame:
    return PB.tripwire(t.filter("pool = 'active'"), t)


@query("artifact_drift", L, sql="""WITH a AS (SELECT id, name, location FROM v_listing WHERE ord % 10 <> 1), b AS (SELECT id, CASE WHEN ord % 9 = 0 THEN name || '!' ELSE name END AS name, location FROM v_listing WHERE ord % 10 <> 2)
SELECT id, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'gone' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (id) WHERE a.name IS DISTINCT FROM b.name OR a.location IS DISTINCT FROM b.location""")
def _(t: DataFrame) -> DataFrame:
    """Rows that two snapshots differ in: a full outer join by id."""
    a = t.filter("ord % 10 <> 1").select("id", c("name").alias("n1"), c("location").alias("l1"))
    b = t.filter("ord % 10 <> 2").select("id", F.when(c("ord") % 9 == 0, F.concat("name", F.lit("!"))).otherwise(c("name")).alias("n2"), c("location").alias("l2"))
    j = a.join(b, "id", "full").filter(~(c("n1").eqNullSafe(c("n2")) & c("l1").eqNullSafe(c("l2"))))
    return j.select("id", F.when(c("n1").isNull(), "added").when(c("n2").isNull(), "gone").otherwise("changed").alias("kind"))


@query("field_changes", L, sql="""SELECT id, unnest([x for x in [CASE WHEN ord % 4 = 0 THEN 'cost' END, CASE WHEN ord % 6 = 0 THEN 'url' END] if x IS NOT NULL]) AS field FROM v_listing WHERE ord % 4 = 0 OR ord % 6 = 0""")
def _(t: DataFrame) -> DataFrame:
    """Fields that an edit changes."""
    old = F.create_map(F.lit("name"), c("name"), F.lit("cost"), F.coalesce("cost", F.lit("")), F.lit("url"), c("url"))
    new = F.create_map(F.lit("name"), c("name"), F.lit("cost"), F.when(c("ord") % 4 == 0, "$99").otherwise(F.coalesce("cost", F.lit(""))), F.lit("url"), F.when(c("ord") % 6 == 0, "u").otherwise(c("url")))
    changed = F.map_filter(F.map_zip_with(old, new, lambda k, a, b: a != b), lambda k, v: v)
    return t.select("id", F.explode(F.map_keys(changed)).alias("field"))


@query("edit_overlay", L, sql="SELECT id, CASE WHEN ord % 7 = 0 THEN 'Edited ' || name ELSE name END AS name, CASE WHEN ord % 5 = 0 THEN NULL ELSE url END AS url, CASE WHEN ord % 5 = 0 THEN url END AS dropped FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    """Edits over rows; an address removed by hand is remembered, so that a later merge doesn't bring it back."""
    edits = t.filter("ord % 7 = 0 or ord % 5 = 0").select("id", F.when(c("ord") % 7 == 0, F.concat(F.lit("Edited "), "name")).alias("e_name"), F.when(c("ord") % 5 == 0, F.array("url")).alias("removed"))
    j = t.join(edits, "id", "left")
    left = F.array_except(F.array("url"), F.coalesce("removed", F.array().cast("array<string>")))
    return j.select("id", F.coalesce("e_name", "name").alias("name"), F.get(left, F.lit(0)).alias("url"), F.get("removed", F.lit(0)).alias("dropped"))


@query("archive_split", L, sql=f"SELECT id, CASE WHEN pool = 'active' AND end_local < {_NOW} - INTERVAL 24 HOUR THEN 'archive' ELSE pool END AS pool FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    return LC.archive_split(t, now())


_REL = f"(coalesce(trusted, false) OR {D.styles('name')} <> ['other'] OR {D.has('name', X.TOPIC)})"
_FAR = f"CASE WHEN lat IS NULL THEN coalesce(NOT list_contains({D.array(P.NEAR_STATES)}, nullif(regexp_extract(location, ', ([A-Z][A-Z])$', 1), '')), false) ELSE {D.km('lat', 'lng', str(P.CENTRE[0]), str(P.CENTRE[1]))} > 50 END"
_OVER = f"({_NOW} - INTERVAL 24 HOUR)"
_ROUTE = f"""WITH {D.PREPARED}, {D.PAIRS}, {D.GRADED}, v AS (SELECT item, last(choice ORDER BY seq) AS choice FROM v_decision GROUP BY item),
bl AS (SELECT id, source, norm || '|' || coalesce(place, '') AS k FROM prep JOIN v ON item = ord WHERE pool = 'pending' AND choice = 'different'),
kn AS (SELECT l.*, choice IS NOT DISTINCT FROM 'skip' AS held, source_rank FROM v_listing l LEFT JOIN v ON item = ord LEFT JOIN v_source s ON s.source = l.source WHERE pool <> 'pending'),
d AS (SELECT a AS id, b AS other, grade FROM graded WHERE grade IS NOT NULL UNION ALL SELECT b, a, grade FROM graded WHERE grade IS NOT NULL),
hits AS (SELECT d.id, grade, other, kn.ord, pool, held, end_local AS klast, source AS ks, source_rank AS kr, recurring AS krec FROM d JOIN kn ON kn.id = other),
live AS (SELECT id, arg_min(grade, (grade, ord)) AS lg, arg_min(other, (grade, ord)) AS lo FROM hits WHERE pool = 'active' GROUP BY id),
gone AS (SELECT * FROM hits WHERE pool = 'archive' QUALIFY row_number() OVER (PARTITION BY id ORDER BY grade, ord) = 1),
f AS (SELECT p.id, p.ord, lo, gone.other AS go, CASE WHEN p.id IN (SELECT id FROM bl) OR (p.source || '~' || p.norm || '|' || coalesce(p.place, '')) IN (SELECT source || '~' || k FROM bl) THEN 'blocked' WHEN {_FAR} THEN 'rejected_out_of_area' WHEN NOT {_REL} THEN 'rejected_irrelevant'
    WHEN gone.grade = 'certain' AND (lg IS NOT DISTINCT FROM 'certain' OR p.end_local < {_OVER} OR held) THEN 'duplicate'
    WHEN gone.grade = 'certain' AND CASE WHEN ks = p.source AND p.recurring AND krec THEN greatest(p.end_local, klast) WHEN kr <= s.source_rank THEN klast ELSE p.end_local END >= {_OVER} THEN 'reactivated'
    WHEN lg = 'certain' THEN 'merged' WHEN lg = 'review' THEN 'pending' WHEN p.end_local < {_OVER} THEN 'skipped_past' WHEN noise >= 60 THEN 'quarantined' ELSE 'added' END AS status
  FROM prep p LEFT JOIN live ON live.id = p.id LEFT JOIN gone ON gone.id = p.id LEFT JOIN v_source s ON s.source = p.source WHERE p.pool = 'pending'),
fresh AS (SELECT id FROM f WHERE status IN ('added', 'quarantined')),
e AS (SELECT b AS id, arg_min(grade, (grade, xo)) AS eg, arg_min(a, (grade, xo)) AS eo FROM graded WHERE grade IS NOT NULL AND a IN (SELECT id FROM fresh) AND b IN (SELECT id FROM fresh) GROUP BY b),
r AS (SELECT f.id, CASE WHEN eg = 'certain' THEN 'duplicate' WHEN eg = 'review' THEN 'pending' ELSE status END AS status,
  CASE WHEN status IN ('added', 'quarantined') THEN eo WHEN status = 'duplicate' THEN coalesce(lo, go) WHEN status = 'reactivated' THEN go WHEN status IN ('merged', 'pending') THEN lo END AS other FROM f LEFT JOIN e ON e.id = f.id)"""


def _routed(t: DataFrame, s: DataFrame, d: DataFrame) -> DataFrame:
    """Pending rows against the others. (Here an archived row whose last decision is to skip is held, a pending one that is different is blocked.)"""
    v = M.latest(d, ["item"], ["seq"]).select("item", "choice")
    decided = t.join(v, t.ord == v.item, "left")
    known = decided.filter("pool <> 'pending'").withColumn("hold", F.when((c("pool") == "archive") & (c("choice") == "skip"), "cancelled")).drop("item", "choice")
    refused = decided.filter("pool = 'pending' and choice = 'different'")
    blocked = refused.select("id", "source", LC.block_key(normalize_name(c("name")), P.place_text(c("location"))).alias("key"))
    return LC.route(t.filter("pool = 'pending'"), known, s, now(), blocked)


@query("route_new", L, "v_source", "v_decision", sql=f"{_ROUTE} SELECT id, status, CASE WHEN status IN ('added', 'merged', 'reactivated') THEN 'active' WHEN status IN ('pending', 'quarantined') THEN 'pending' WHEN starts_with(status, 'rejected') THEN 'rejected' END AS target, other FROM r")
def _(t: DataFrame, s: DataFrame, d: DataFrame) -> DataFrame:
    return _routed(t, s, d).drop("ord")


@query("ingest_pools", L, "v_source", "v_decision", sql=f"""{_ROUTE}, fo AS (SELECT other, r.id FROM r WHERE status IN ('merged', 'reactivated')), gr AS (
  SELECT other AS g, l.id, ord + {1 << 40} AS o, name, location, source FROM fo JOIN v_listing l ON l.id = fo.id UNION ALL SELECT l.id, l.id, ord, name, location, source FROM v_listing l WHERE l.id IN (SELECT other FROM fo))
SELECT r.id, ord, CASE status WHEN 'added' THEN 'active' ELSE 'pending' END AS pool, name, location, 1 AS members FROM r JOIN v_listing l ON l.id = r.id WHERE status IN ('added', 'pending', 'quarantined')
UNION ALL SELECT g, min(o), 'active', arg_min(name, (source_rank, o)), arg_min(location, (source_rank, o)) FILTER (location IS NOT NULL), count(*) FROM gr JOIN v_source s ON s.source = gr.source GROUP BY g""")
def _(t: DataFrame, s: DataFrame, d: DataFrame) -> DataFrame:
    """The rows that a run changes: new ones, and known ones with what was folded into them."""
    changed = LC.upserts(t.filter("pool = 'pending'"), _routed(t, s, d), t.filter("pool <> 'pending'"), s)
    return changed.select("id", "ord", "pool", "name", "location", "members")


@query("reactivate", L, "v_source", "v_decision", sql=f"{_ROUTE} SELECT id, other FROM r WHERE status = 'reactivated'")
def _(t: DataFrame, s: DataFrame, d: DataFrame) -> DataFrame:
    return _routed(t, s, d).filter("status = 'reactivated'").select("id", "other")


@query("apply_decisions", L, "v_decision", sql="""WITH v AS (SELECT item, last(choice ORDER BY seq) AS choice FROM v_decision GROUP BY item)
SELECT id, CASE WHEN (choice = 'approve' AND location IS NULL) OR choice = 'skip' THEN pool WHEN choice IN ('approve', 'different') THEN 'active' ELSE 'archive' END AS pool, choice = 'approve' AND location IS NULL AS refused FROM v_listing JOIN v ON item = ord WHERE pool = 'pending'""")
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    return LC.apply_decisions(t, d)


@query("latest_answer", "v_decision", sql="SELECT item, last(choice ORDER BY seq) AS choice, max(seq) AS seq FROM v_decision WHERE choice <> 'skip' GROUP BY item")
def _(d: DataFrame) -> DataFrame:
    """The last valid answer of each item; a skipped one leaves it open."""
    return d.filter("choice <> 'skip'").groupBy("item").agg(F.max_by("choice", "seq").alias("choice"), F.max("seq").alias("seq"))


@query("worklist_progress", "v_decision", sql="SELECT actor, count(*) AS asked, count(*) FILTER (choice <> 'skip') AS answered, count(*) FILTER (choice = 'skip') AS skipped FROM v_decision GROUP BY actor")
def _(d: DataFrame) -> DataFrame:
    return d.groupBy("actor").agg(F.count("*").alias("asked"), F.count_if(c("choice") != "skip").alias("answered"), F.count_if(c("choice") == "skip").alias("skipped"))


@query("verdict_latest", "v_decision", sql="SELECT least(item, item + seq) AS a, greatest(item, item + seq) AS b, last(choice ORDER BY seq, actor) AS verdict FROM v_decision WHERE choice IN ('same', 'different') GROUP BY 1, 2")
def _(d: DataFrame) -> DataFrame:
    """Verdicts by unordered pair, the last one stands."""
    v = d.filter("choice in ('same', 'different')").select(F.least("item", c("item") + c("seq")).alias("a"), F.greatest("item", c("item") + c("seq")).alias("b"), "choice", "seq", "actor")
    return v.groupBy("a", "b").agg(F.max_by("choice", F.struct("seq", "actor")).alias("verdict"))


@query("conflict_rulings", L, "v_decision", sql="""WITH v AS (SELECT item, last(choice ORDER BY seq) AS choice FROM v_decision GROUP BY item)
SELECT location, string_agg(DISTINCT start_local::DATE::VARCHAR, ',' ORDER BY start_local::DATE::VARCHAR) AS excluded FROM v_listing JOIN v ON item = ord WHERE choice = 'different' GROUP BY location""")
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    """A ruling that a listing replaces the regular night excludes its date there."""
    v = M.latest(d, ["item"], ["seq"]).filter("choice = 'different'").select("item")
    j = t.join(v, t.ord == v.item).groupBy("location").agg(F.array_join(F.array_sort(F.collect_set(F.to_date("start_local").cast("string"))), ",").alias("excluded"))
    return j


_VENUE = "lower(trim(split_part(coalesce(location, ''), ',', 1)))"
_LIVE = f"""{_SLUGS}, lv AS (SELECT l.*, slug, {D.norm('name')} AS norm, {_VENUE} AS venue, {D.words(D.norm('name'))} AS w FROM v_listing l JOIN u USING (id) WHERE l.pool = 'active'),
rg AS (SELECT *, {D.norm('name')} AS norm, {_VENUE} AS venue, {D.words(D.norm('name'))} AS w FROM v_registry),
tj AS (SELECT rg.slug, lv.slug AS target, len(list_intersect(rg.w, lv.w)) / len(list_distinct(rg.w || lv.w)) AS x FROM rg JOIN lv ON rg.start_local >= lv.start_local - INTERVAL 2 DAY AND rg.start_local <= lv.start_local + INTERVAL 2 DAY
  WHERE coalesce(sqrt(((rg.lat - lv.lat) * 111) ** 2 + ((rg.lng - lv.lng) * 111 * cos(radians((rg.lat + lv.lat) / 2))) ** 2) <= 0.2, rg.venue <> '' AND lv.venue <> '' AND (contains(rg.venue, lv.venue) OR contains(lv.venue, rg.venue)))),
tk AS (SELECT *, rank() OVER (PARTITION BY slug ORDER BY x DESC) AS rk FROM tj WHERE x >= 0.5), tt AS (SELECT slug, min(target) AS target FROM tk WHERE rk = 1 GROUP BY slug HAVING count(*) = 1)"""


def _live(t: DataFrame) -> DataFrame:
    return PB.unique_slugs(t, carry=tuple(t.columns)).filter("pool = 'active'")


@query("slug_resolve", "v_registry", L, "v_decision", sql=f"""WITH RECURSIVE {_LIVE}, e AS (SELECT 'L' || item::VARCHAR AS u, 'L' || (item + seq)::VARCHAR AS v FROM v_decision WHERE choice = 'same'), ee AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS node, u AS other FROM ee UNION SELECT r.node, ee.v FROM reach r JOIN ee ON ee.u = r.other), grp AS (SELECT node, min(other) AS g FROM reach GROUP BY node),
bi AS (SELECT id, arg_min(slug, ord) AS t FROM lv GROUP BY id), bg AS (SELECT g, arg_min(slug, ord) AS t FROM lv JOIN grp ON node = id GROUP BY g), bn AS (SELECT norm, venue, arg_min(slug, ord) AS t FROM lv GROUP BY 1, 2)
SELECT rg.slug, CASE WHEN coalesce(bi.t, bg.t, bn.t, tt.target) IS NULL THEN 'ended' ELSE 'alias' END AS status, coalesce(bi.t, bg.t, bn.t, tt.target) AS target,
  CASE WHEN bi.t IS NOT NULL THEN 'renamed' WHEN bg.t IS NOT NULL THEN 'merged' WHEN bn.t IS NOT NULL THEN 'rescraped' WHEN tt.target IS NOT NULL THEN 'retitled' END AS reason
FROM rg LEFT JOIN bi ON bi.id = rg.id LEFT JOIN grp ON grp.node = rg.id LEFT JOIN bg ON bg.g = grp.g LEFT JOIN bn ON bn.norm = rg.norm AND bn.venue = rg.venue LEFT JOIN tt ON tt.slug = rg.slug""")
def _(r: DataFrame, t: DataFrame, d: DataFrame) -> DataFrame:
    """Retired addresses: by id, by verdicts that two are the same, by name and venue, by title."""
    number = lambda x: F.concat(F.lit("L"), x.cast("string"))
    same = M.groups(d.filter("choice = 'same'").select(number(c("item")).alias("a"), number(c("item") + c("seq")).alias("b")))
    return PB.resolve(r, _live(t), same)


@query("slug_retitle", "v_registry", L, sql=f"WITH {_LIVE} SELECT slug, target FROM tt")
def _(r: DataFrame, t: DataFrame) -> DataFrame:
    """The one live listing at the place within two days whose title is most alike; a tie gives none."""
    return PB.retitled(r, _live(t))


@query("slug_chain", "v_registry", L, sql="""WITH RECURSIVE l AS (SELECT slug, 'old-' || (regexp_extract(slug, '\\d+')::BIGINT + 1)::VARCHAR AS target FROM v_registry),
h AS (SELECT slug, target, 0 AS n FROM l UNION ALL SELECT h.slug, l.target, n + 1 FROM h JOIN l ON l.slug = h.target WHERE n < 10), e AS (SELECT slug, arg_max(target, n) AS target FROM h GROUP BY slug)
SELECT slug, CASE WHEN target IN (SELECT 'old-' || ord::VARCHAR FROM v_listing WHERE pool = 'active') THEN target END AS target FROM e""")
def _(r: DataFrame, t: DataFrame) -> DataFrame:
    """Alias chains followed to their ends; an end that isn't live is none. (Here each address points to the next number.)"""
    nxt = F.concat(F.lit("old-"), F.regexp_extract("slug", r"\d+", 0).cast("long") + 1)
    live = t.filter("pool = 'active'").select(F.concat(F.lit("old-"), c("ord").cast("string")).alias("slug"))
    return PB.flatten_chains(r.select("slug", nxt.alias("target")), live)


@query("slug_record", "v_registry", L, sql=f"""WITH {_SLUGS}, p AS (SELECT CASE WHEN ord % 4 = 0 THEN slug ELSE 'old-' || ord::VARCHAR END AS slug, l.id, name, location, start_local, lat, lng FROM v_listing l JOIN (SELECT id, slug FROM u) USING (id) WHERE pool = 'active')
SELECT coalesce(p.slug, r.slug) AS slug, coalesce(p.id, r.id) AS id, coalesce(p.name, r.name) AS name, coalesce(p.lat, r.lat) AS lat, CASE WHEN r.slug IS NULL THEN {_NOW} ELSE r.start_local END AS first_seen, CASE WHEN p.slug IS NULL THEN r.start_local ELSE {_NOW} END AS last_seen FROM v_registry r FULL JOIN p ON p.slug = r.slug""")
def _(r: DataFrame, t: DataFrame) -> DataFrame:
    """The register after a publish: known addresses keep the time first seen. (Here live rows keep their old address unless their number divides by 4.)"""
    live = _live(t).withColumn("slug", F.when(c("ord") % 4 == 0, c("slug")).otherwise(F.concat(F.lit("old-"), c("ord").cast("string"))))
    known = r.withColumn("first_seen", c("start_local")).withColumn("last_seen", c("start_local"))
    return PB.record(known, live, now()).select("slug", "id", "name", "lat", "first_seen", "last_seen")


@query("page_meta", "v_link", sql=r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?is)<meta[^>]*(?:property|name)="og:title"[^>]*content="([^"]*)"', 1) AS og_title,
  coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]*(?:property|name)="og:description"[^>]*content="([^"]*)"', 1), ''), regexp_extract(html, '(?is)<meta[^>]*(?:property|name)="description"[^>]*content="([^"]*)"', 1)) AS description,
  regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical FROM v_link""")
def _(p: DataFrame) -> DataFrame:
    return A.page_titles(p)


_VERDICT = """v AS (SELECT *, CASE WHEN error IS NOT NULL AND status IS NULL THEN CASE WHEN error = 'ConnectionError' THEN 'broken' ELSE 'unverifiable' END WHEN status IS NULL THEN 'unverifiable' WHEN status IN (404, 410) THEN 'broken'
  WHEN status >= 500 OR status IN (401, 403, 429) THEN 'unverifiable' WHEN status >= 400 THEN 'broken' ELSE 'ok' END AS verdict FROM v_link)"""


@query("link_health", "v_link", sql=f"WITH {_VERDICT} SELECT page_id, verdict FROM v")
def _(p: DataFrame) -> DataFrame:
    return A.link_health(p).select("page_id", "verdict")


@query("host_guard", "v_link", sql=f"""WITH {_VERDICT}, h AS (SELECT host || (page_id % 60)::VARCHAR AS host, page_id, verdict FROM v), b AS (SELECT host FROM h GROUP BY host HAVING count(*) >= 3 AND bool_and(verdict = 'broken'))
SELECT page_id, CASE WHEN host IN (SELECT host FROM b) THEN 'unverifiable' ELSE verdict END AS guarded FROM h""")
def _(p: DataFrame) -> DataFrame:
    rows = A.link_health(p).withColumn("url", F.concat(F.lit("https://"), "host", (c("page_id") % 60).cast("string"), F.lit("/x")))
    return A.guard_hosts(rows).select("page_id", "guarded")


@query("dead_link_fix", "v_link", sql=f"""WITH {_VERDICT}, n AS (SELECT host, url, verdict, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM v), d AS (SELECT host, url AS dead FROM n WHERE n = 1 AND verdict = 'broken')
SELECT d.host, dead, arg_min(n.url, n.n) AS alternate FROM d LEFT JOIN n ON n.host = d.host AND n.n > 1 AND n.verdict = 'ok' GROUP BY d.host, dead""")
def _(p: DataFrame) -> DataFrame:
    return A.first_live_alternate(A.link_health(p), "host").select("host", "dead", "alternate")


@query("dangling_links", "v_link", sql=r"""WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(https?://[^"#?]+)', 1)) AS href FROM v_link), p AS (SELECT DISTINCT regexp_extract(url, '^[^#?]+') AS href FROM v_link) SELECT href FROM h WHERE href NOT IN (SELECT href FROM p)""")
def _(p: DataFrame) -> DataFrame:
    """Linked addresses that no page has."""
    hrefs = p.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="(https?://[^"#?]+)'), F.lit(1))).alias("href")).distinct()
    return hrefs.join(p.select(F.regexp_extract("url", r"^[^#?]+", 0).alias("href")), "href", "left_anti")


@query("link_harvest", "v_link", sql=r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS hs FROM v_link), x AS (SELECT page_id, regexp_replace(unnest(hs), '[?#].*$', '') AS href, generate_subscripts(hs, 1) AS i FROM h),
d AS (SELECT page_id, href, min(i) AS i FROM x GROUP BY page_id, href) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, href FROM d QUALIFY href <> ''""")
def _(p: DataFrame) -> DataFrame:
    """Links of a page without query and fragment, in order, each once."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]+)"'), F.lit(1)), lambda x: F.regexp_replace(x, r"[?#].*$", "")))
    return p.select("page_id", F.posexplode(found).alias("pos", "href")).filter("href <> ''")


_AGREE = """k AS (SELECT listing_ord, CASE WHEN location IS NULL OR claim_place IS NULL THEN 0 WHEN location = claim_place OR starts_with(location, claim_place || ',') THEN 1 WHEN city_level THEN 1 ELSE 2 END AS p,
  CASE WHEN abs(abs(date_diff('second', start_local, claim_local)) - 14400) < 60 OR abs(abs(date_diff('second', start_local, claim_local)) - 18000) < 60 THEN 0 WHEN claim_local IS NULL THEN 0 WHEN claim_local::DATE = start_local::DATE THEN 1 ELSE 2 END AS d,
  coalesce(abs(abs(date_diff('second', start_local, claim_local)) - 14400) < 60 OR abs(abs(date_diff('second', start_local, claim_local)) - 18000) < 60, false) AS s FROM v_claim JOIN v_listing ON ord = listing_ord),
g AS (SELECT listing_ord, count(*) AS claims, ['unknown', 'agree', 'disagree'][max(p) + 1] AS place, ['unknown', 'agree', 'disagree'][max(d) + 1] AS date, count(*) FILTER (s) AS shifts FROM k GROUP BY listing_ord)"""


@query("claim_agreement", L, "v_claim", sql=f"WITH {_AGREE} SELECT * FROM g")
def _(t: DataFrame, k: DataFrame) -> DataFrame:
    return A.claim_agreement(t, k)


@query("claim_totals", L, "v_claim", sql=f"WITH {_AGREE} SELECT place, date, count(*) AS listings, count(*) FILTER (claims > 1) AS multi FROM g GROUP BY place, date")
def _(t: DataFrame, k: DataFrame) -> DataFrame:
    return A.claim_agreement(t, k).groupBy("place", "date").agg(F.count("*").alias("listings"), F.count_if(c("claims") > 1).alias("multi"))


_STATUS = f"{_AGREE}, st AS (SELECT id, pool, start_local, CASE WHEN claims IS NULL THEN 'no_source' WHEN date = 'disagree' AND NOT recurring THEN 'date_mismatch' WHEN place = 'disagree' THEN 'location_mismatch' WHEN date = 'agree' OR place = 'agree' THEN 'confirmed' ELSE 'reachable_only' END AS status FROM v_listing LEFT JOIN g ON listing_ord = ord)"


@query("verify_status", L, "v_claim", sql=f"WITH {_STATUS} SELECT id, status FROM st")
def _(t: DataFrame, k: DataFrame) -> DataFrame:
    return A.verification(t, k)


@query("verification_gaps", L, "v_claim", sql=f"WITH {_STATUS} SELECT id, status FROM st WHERE pool = 'active' AND status NOT IN ('confirmed')")
def _(t: DataFrame, k: DataFrame) -> DataFrame:
    return t.filter("pool = 'active'").select("id").join(A.verification(t, k), "id").filter("status <> 'confirmed'")


@query("report_merge", L, "v_claim", sql=f"WITH {_STATUS}, fresh AS (SELECT id, status FROM st WHERE start_local >= {_NOW}) SELECT id, status, true AS checked FROM fresh UNION ALL SELECT id, CASE WHEN location IS NULL THEN 'no_source' ELSE 'confirmed' END, false FROM v_listing WHERE pool = 'active' AND id NOT IN (SELECT id FROM fresh)")
def _(t: DataFrame, k: DataFrame) -> DataFrame:
    """Checked rows replace theirs; rows not checked stay as they were while their listing is live. (Here coming listings were checked; the report before has all.)"""
    before = t.select("id", F.when(c("location").isNull(), "no_source").otherwise("confirmed").alias("status"))
    fresh = A.verification(t, k).join(t.filter(c("start_local") >= now()).select("id"), "id", "left_semi")
    return A.merge_report(before, fresh, t.filter("pool = 'active'"))


@query("stale_rows", L, sql=f"SELECT id FROM v_listing WHERE pool = 'active' AND (ord % 4 = 0 OR start_local - INTERVAL 1 DAY * (ord % 30) < {_NOW} - INTERVAL 14 DAY)")
def _(t: DataFrame) -> DataFrame:
    """Never verified, or longer than two weeks ago."""
    checked = t.filter("ord % 4 <> 0").select("id", F.timestamp_add("DAY", -(c("ord") % 30).cast("int"), c("start_local")).cast("timestamp_ntz").alias("at"))
    fresh = checked.filter(c("at") >= now() - F.expr("INTERVAL '14' DAY")).select("id")
    return t.filter("pool = 'active'").select("id").join(fresh, "id", "left_anti")


_CANCEL = D.cancelled('html')
_SPLIT = "[w for w in list_distinct(string_split_regex({x}, '\\s+')) if w NOT IN ('', 'the', 'at', 'in')]"
_PAGES = f"""pf AS (SELECT page_id, error, status AS http, {_CANCEL} AS cancel_word FROM v_link),
kf AS (SELECT * FROM v_claim QUALIFY row_number() OVER (PARTITION BY listing_ord ORDER BY claim_no, claim_id, claim_place NULLS FIRST, claim_local) = 1),
ff AS (SELECT l.*, error, http, cancel_word, listing_ord IS NOT NULL AS structured, CASE claim_id % 9 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'scheduled' END AS declared, CASE WHEN ord % 6 = 0 AND abs(date_diff('second', claim_local, start_local)) <= 900 THEN NULL ELSE claim_local END AS sstart,
  lower(coalesce(claim_place, '')) AS theirs, lower(coalesce(location, '')) AS mine, CASE WHEN ord % 8 = 0 THEN '' WHEN ord % 8 = 1 THEN 'https://www.facebook.com/events/' || ord::VARCHAR WHEN ord % 8 = 2 THEN 'https://instagram.com/p/' || ord::VARCHAR ELSE url END AS link,
  s.trusted FROM v_listing l LEFT JOIN pf ON page_id = ord % (SELECT count(*) FROM v_link) LEFT JOIN kf ON listing_ord = ord LEFT JOIN v_source s ON s.source = l.source),
fw AS (SELECT *, {_SPLIT.format(x='mine')} AS mw, {_SPLIT.format(x='theirs')} AS tw FROM ff),
vp AS (SELECT id, pool, CASE WHEN ord % 11 = 0 THEN 'confirmed' WHEN link = '' THEN CASE WHEN trusted AND ord % 3 = 0 THEN 'calendar_only' ELSE 'no_source' END WHEN ord % 8 = 1 THEN 'needs_browser' WHEN ord % 8 = 2 THEN 'unverifiable' WHEN error IS NOT NULL THEN 'unreachable' WHEN http >= 400 THEN 'page_gone'
  WHEN declared = 'cancelled' THEN 'cancelled' WHEN declared IS NULL AND cancel_word THEN 'needs_review' WHEN NOT structured THEN 'reachable_only' WHEN sstart IS NOT NULL AND NOT recurring AND sstart::DATE <> start_local::DATE THEN 'date_mismatch'
  WHEN mine <> '' AND theirs <> '' AND NOT contains(mine, theirs) AND NOT contains(theirs, mine) AND len(mw) > 0 AND len(tw) > 0 AND len(list_intersect(mw, tw)) < greatest(1.0, 0.3 * least(len(mw), len(tw))) THEN 'location_mismatch'
  WHEN (sstart IS NOT NULL AND NOT recurring) OR theirs <> '' OR declared = 'scheduled' THEN 'confirmed' ELSE 'reachable_only' END AS status FROM fw)"""


def _verified(t: DataFrame, k: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    """Statuses of all listings. (Here a listing's page is the one of its number modulo the number of pages, its linked data its first claim; every eighth has no link, the
    next two social ones; every eleventh was seen in a browser.)"""
    first = k.groupBy(c("listing_ord").alias("ord")).agg(F.min(F.struct("claim_no", "claim_id", "claim_place", "claim_local")).alias("k"))
    pages = p.select(c("page_id").alias("page"), "error", c("status").alias("http"), X.cancellation_mention(c("html")).alias("cancel_word"))
    link = F.when(c("ord") % 8 == 0, "").when(c("ord") % 8 == 1, F.concat(F.lit("https://www.facebook.com/events/"), c("ord").cast("string"))).when(c("ord") % 8 == 2, F.concat(F.lit("https://instagram.com/p/"), c("ord").cast("string"))).otherwise(c("url"))
    rows = t.withColumn("url", link).join(first, "ord", "left").join(p.agg(F.count("*").alias("n_pages"))).join(pages, c("ord") % c("n_pages") == c("page"), "left").join(s.select("source", "trusted"), "source", "left")
    declared = F.when(c("k.claim_id") % 9 == 0, "cancelled").when(c("k.claim_id") % 9 == 1, "scheduled")
    facts = rows.select(
        "id", "error", "http", "cancel_word", c("k").isNotNull().alias("structured"), declared.alias("declared"), c("k.claim_local").alias("source_start"), c("k.claim_place").alias("source_place"), F.when(c("ord") % 6 == 0, c("start_local")).alias("fetched_at"),
        F.when(c("ord") % 11 == 0, "confirmed").alias("attested"), now().alias("attested_until"), "trusted", F.when(c("ord") % 3 == 0, now() - F.expr("INTERVAL '3' DAY")).alias("searched_at"),
    )
    return A.verify(rows, facts, now())


@query("verify_page", L, "v_claim", "v_link", "v_source", sql=f"WITH {_PAGES} SELECT id, status FROM vp")
def _(t: DataFrame, k: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    return _verified(t, k, p, s)


_READY = f"""{_PAGES}, {D.PREPARED}, {D.PAIRS}, {D.GRADED}, act AS (SELECT * FROM v_listing WHERE pool = 'active'),
n AS (SELECT 'scraper_health' AS check_name, (SELECT count(*) FROM (SELECT s.source FROM v_source s LEFT JOIN v_listing l ON l.source = s.source GROUP BY s.source HAVING coalesce(max(start_local) < {_NOW} - INTERVAL 48 HOUR, true))) AS hard, 0 AS soft
  UNION ALL SELECT 'facebook_evidence', (SELECT count(*) FROM act WHERE start_local > {_NOW} + INTERVAL 5 MINUTE OR start_local < {_NOW} - INTERVAL 14 DAY), 0 UNION ALL SELECT 'pending_review', (SELECT count(*) FROM v_listing WHERE pool = 'pending'), 0
  UNION ALL SELECT 'rejected_audit', (SELECT count(*) FROM v_listing WHERE {_FAR} AND pool = 'pending'), 0 UNION ALL SELECT 'facebook_signals', (SELECT count(*) FROM act a WHERE a.recurring AND NOT EXISTS (SELECT 1 FROM act b WHERE b.source = a.source AND b.start_local::DATE = a.start_local::DATE + 1)), 0
  UNION ALL SELECT 'coordinates', (SELECT count(*) FROM act WHERE lat IS NULL OR lng IS NULL), 0 UNION ALL SELECT 'verification', (SELECT count(*) FROM vp WHERE pool = 'active' AND status NOT IN ('confirmed', 'calendar_only', 'reachable_only')), (SELECT count(*) FROM vp WHERE pool = 'active' AND status = 'reachable_only')
  UNION ALL SELECT 'active_duplicates', (SELECT count(*) FROM graded WHERE grade IS NOT NULL AND a IN (SELECT id FROM act) AND b IN (SELECT id FROM act)), 0 UNION ALL SELECT 'venue_conflicts', (SELECT count(DISTINCT a.id) FROM act a JOIN v_venue v ON v.location = a.location AND v.dow = dayofweek(a.start_local)), 0
  UNION ALL SELECT 'publish_coordinates', (SELECT count(*) FROM act a LEFT JOIN v_source s USING (source) WHERE (lat IS NULL OR lng IS NULL) AND NOT coalesce(unreliable, false)), 0 UNION ALL SELECT 'start_hours', (SELECT count(*) FROM act WHERE hour(start_local) BETWEEN 1 AND 8), 0
  UNION ALL SELECT 'publish_tripwire', (SELECT count(*) FROM (SELECT (SELECT count(*) FROM act) AS a, (SELECT count(*) FROM v_listing) AS b) WHERE b >= 20 AND a < b * 0.7), 0 UNION ALL SELECT 'generated_artifacts', (SELECT count(*) FROM act WHERE ord % 10 = 1), 0),
rd AS (SELECT check_name, CASE WHEN hard > 0 THEN CASE WHEN check_name IN ('rejected_audit', 'facebook_signals', 'generated_artifacts') THEN 'warning' ELSE 'blocker' END WHEN soft > 0 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN hard > 0 THEN hard ELSE soft END AS n FROM n)"""


def _conflicts(live: DataFrame, v: DataFrame) -> DataFrame:
    """Ids of rows on a weekday and at a place that a venue has: of each place and weekday once, however many venues share it."""
    nights = v.select("location", c("dow").cast("int").alias("dow")).distinct()
    return live.withColumn("dow", F.dayofweek("start_local") - 1).join(nights, ["location", "dow"], "left_semi").select("id").distinct()


def _ready(t: DataFrame, k: DataFrame, p: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    """Findings of every check. (Here captures are as old as the row's start, signals are the recurring rows, the published file lacks rows whose number ends in 1.)"""
    live = t.filter("pool = 'active'")
    status = _verified(t, k, p, s).join(live.select("id"), "id", "left_semi")
    good = ["confirmed", "calendar_only", "reachable_only"]
    seen = t.groupBy("source").agg(F.max("start_local").alias("last_run"))
    stale = s.join(seen, "source", "left").filter(F.coalesce(c("last_run") < now() - F.expr("INTERVAL '48' HOUR"), F.lit(True)))
    day = F.to_date("start_local")
    unmatched = live.filter("recurring").select("source", F.date_add(day, 1).alias("d")).join(live.select("source", day.alias("d")), ["source", "d"], "left_anti")
    conflicts = _conflicts(live, v)
    evidence = live.filter((c("start_local") > now() + F.expr("INTERVAL '5' MINUTE")) | (c("start_local") < now() - F.expr("INTERVAL '14' DAY")))
    bare = live.filter("lat is null or lng is null")
    checks = {
        "scraper_health": stale, "facebook_evidence": evidence, "pending_review": t.filter("pool = 'pending'"), "rejected_audit": t.filter("pool = 'pending'").filter(P.is_out_of_area(c("lat"), c("lng"), c("location"))), "facebook_signals": unmatched,
        "coordinates": bare, "verification": status.filter(~c("status").isin(good)), "reachable_only": status.filter("status = 'reachable_only'"), "venue_conflicts": conflicts,
        "publish_coordinates": bare.join(s.filter("unreliable").select("source"), "source", "left_anti"), "start_hours": live.filter(T.implausible_start_hour(c("start_local"))), "publish_tripwire": PB.tripwire(live, t).filter("refuse"), "generated_artifacts": live.filter("ord % 10 = 1"),
    }
    alike = CP.totals(live).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("active_duplicates").alias("check_name"), "n")
    return Q.readiness(reduce(DataFrame.union, (Q.findings(rows, name) for name, rows in checks.items()), alike))


@query("readiness", L, "v_claim", "v_link", "v_source", "v_venue", sql=f"WITH {_READY} SELECT * FROM rd")
def _(t: DataFrame, k: DataFrame, p: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    return _ready(t, k, p, s, v)


@query("publish_gate", L, "v_claim", "v_link", "v_source", "v_venue", sql=f"WITH {_READY}, {_VERDICT.replace('v AS (', 'lk AS (', 1)}, o AS (SELECT (SELECT count(*) FROM rd WHERE status = 'blocker') AS blockers, (SELECT count(*) FROM v_listing WHERE pool = 'pending') AS questions, (SELECT count(*) FROM lk WHERE verdict = 'broken') AS broken) SELECT blockers = 0 AND questions = 0 AND broken = 0 AS open, * FROM o")
def _(t: DataFrame, k: DataFrame, p: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    return Q.publish_gate(_ready(t, k, p, s, v), t.filter("pool = 'pending'"), A.link_health(p))


_WORK = f"""{_READY}, {_AGREE.replace(chr(10) + "g AS (", chr(10) + "ga AS (")}, dup AS (SELECT id, min(other) AS other FROM (SELECT a AS id, b AS other FROM graded WHERE grade IS NOT NULL UNION ALL SELECT b, a FROM graded WHERE grade IS NOT NULL) WHERE other IN (SELECT id FROM act) GROUP BY id),
q AS (SELECT l.id, CASE WHEN dup.id IS NULL THEN 'new' ELSE 'possible_duplicate' END AS kind, other FROM v_listing l LEFT JOIN dup ON dup.id = l.id WHERE pool = 'pending'
  UNION ALL SELECT a, 'active_duplicate', b FROM graded WHERE grade IS NOT NULL AND a IN (SELECT id FROM act) AND b IN (SELECT id FROM act)
  UNION ALL SELECT id, CASE status WHEN 'date_mismatch' THEN 'date' WHEN 'location_mismatch' THEN 'location' WHEN 'no_source' THEN 'no_link' WHEN 'cancelled' THEN 'cancelled' WHEN 'needs_review' THEN 'cancelled' ELSE 'broken_link' END, NULL FROM vp
    WHERE pool = 'active' AND status IN ('date_mismatch', 'location_mismatch', 'no_source', 'cancelled', 'needs_review', 'page_gone', 'unreachable')
  UNION ALL SELECT act.id, 'link_date_conflict', NULL FROM act JOIN ga ON listing_ord = ord WHERE date = 'disagree' UNION ALL SELECT act.id, 'link_location_conflict', NULL FROM act JOIN ga ON listing_ord = ord WHERE place = 'disagree'
  UNION ALL SELECT DISTINCT a.id, 'venue_conflict', NULL FROM act a JOIN v_venue v ON v.location = a.location AND v.dow = dayofweek(a.start_local)
  UNION ALL SELECT a.id, 'signal', NULL FROM act a WHERE a.recurring AND NOT EXISTS (SELECT 1 FROM act b WHERE b.source = a.source AND b.start_local::DATE = a.start_local::DATE + 1)
  UNION ALL SELECT id, 'rejected', NULL FROM v_listing WHERE {_FAR} AND pool = 'pending' UNION ALL SELECT id, 'big_event', NULL FROM act WHERE {D.has(D.norm('name'), X.BIG_NAME)})"""


@query("worklist_kinds", L, "v_claim", "v_link", "v_source", "v_venue", sql=f"WITH {_WORK} SELECT kind, count(*) AS n, min(id) AS example, count(DISTINCT other) AS others FROM q GROUP BY kind")
def _(t: DataFrame, k: DataFrame, p: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    live = t.filter("pool = 'active'")
    day = F.to_date("start_local")
    signals = live.filter("recurring").select("id", "source", F.date_add(day, 1).alias("d")).join(live.select("source", day.alias("d")), ["source", "d"], "left_anti")
    conflicts = _conflicts(live, v)
    far = t.filter("pool = 'pending'").filter(P.is_out_of_area(c("lat"), c("lng"), c("location")))
    claims = A.claim_agreement(t, k).join(t.select("id", c("ord").alias("listing_ord")), "listing_ord").select("id", "date", "place")
    q = Q.worklist(t, M.grade_pairs(t), _verified(t, k, p, s), claims, conflicts, signals, far)
    return q.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("example"), F.countDistinct("other").alias("others"))


@query("auto_fixes", L, sql=f"SELECT id, 'drop_past' AS fix FROM v_listing WHERE pool = 'pending' AND end_local < {_NOW} - INTERVAL 24 HOUR UNION ALL SELECT id, 'archive_cancelled' FROM v_listing WHERE pool = 'active' AND ord % 97 = 0")
def _(t: DataFrame) -> DataFrame:
    past = t.filter((c("pool") == "pending") & (c("end_local") < now() - F.expr("INTERVAL '24' HOUR"))).select("id", F.lit("drop_past").alias("fix"))
    return past.union(t.filter("pool = 'active' and ord % 97 = 0").select("id", F.lit("archive_cancelled")))


@query("link_guard", L, "v_link", sql=f"""WITH l AS (SELECT ord, {D.words(D.norm('name'))} AS w FROM v_listing), p AS (SELECT page_id, status, url, {D.words(D.norm("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS tw FROM v_link)
SELECT page_id, CASE WHEN coalesce(status, 0) <> 200 THEN 'status' WHEN contains(url, '/share/') THEN 'wrapper' WHEN len(list_intersect(w, tw)) >= 0.6 * len(w) THEN 'accepted' ELSE 'other_event' END AS verdict FROM p JOIN l ON ord = page_id""")
def _(t: DataFrame, p: DataFrame) -> DataFrame:
    """Whether a page may be the link of a listing: reachable, no wrapper, and names most of its words."""
    from ..functions.names import content_words

    w = content_words(normalize_name(c("name")))
    tw = content_words(normalize_name(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    verdict = F.when(F.coalesce("status", F.lit(0)) != 200, "status").when(c("p.url").contains("/share/"), "wrapper").when(F.size(F.array_intersect(w, tw)) >= F.size(w) * 0.6, "accepted").otherwise("other_event")
    return p.alias("p").join(t.select("ord", "name"), c("page_id") == c("ord")).select("page_id", verdict.alias("verdict"))


