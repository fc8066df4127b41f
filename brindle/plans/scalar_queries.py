"""Queries of the Column functions, one or a few functions each."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import places as P
from ..functions import text as X
from ..functions import timefn as T
from ..functions import urls as U
from ..operators import places as PL
from ..sources.adapters import AS_OF
from . import duck as D
from .registry import query

c = F.col
L = "v_listing"


def _sorted_text(a: Column) -> Column:
    return F.array_join(F.array_sort(a), " ")


@query("normalize_name", L, sql=f"SELECT id, {D.norm('name')} AS norm FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", N.normalize_name(c("name")).alias("norm"))


@query("content_words", L, sql=f"SELECT id, array_to_string({D.words(D.norm('name'))}, ' ') AS words FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", _sorted_text(N.content_words(N.normalize_name(c("name")))).alias("words"))


@query("distinctive_words", L, sql=f"SELECT id, array_to_string({D.telling(D.words(D.norm('name')))}, ' ') AS words FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", _sorted_text(N.distinctive_words(N.content_words(N.normalize_name(c("name"))))).alias("words"))


@query("special_edition", L, sql=f"SELECT id, {D.has(D.norm('name'), N.SPECIAL_EDITION)} AS special FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", N.is_special_edition(N.normalize_name(c("name"))).alias("special"))


@query("one_edit_pairs", "v_name", sql="SELECT DISTINCT name, variant, levenshtein(name, variant) <= 1 AS near FROM v_name")
def _(t: DataFrame) -> DataFrame:
    return t.select("name", "variant", N.within_one_edit(c("name"), c("variant")).alias("near")).distinct()


@query("shared_words", "v_name", sql=f"""WITH n AS (SELECT DISTINCT name AS a, variant AS b FROM v_name)
SELECT x.a, y.b, len(list_intersect({D.words('x.a')}, {D.words('y.b')})) AS shared FROM n x JOIN n y ON split_part(x.a, ' ', 1) = split_part(y.b, ' ', 1)""")
def _(t: DataFrame) -> DataFrame:
    n = t.select(c("name").alias("a"), c("variant").alias("b")).distinct()
    x, y = n.select("a", F.split("a", " ")[0].alias("k")), n.select("b", F.split("b", " ")[0].alias("k"))
    return x.join(y, "k").select("a", "b", F.size(F.array_intersect(N.content_words(c("a")), N.content_words(c("b")))).alias("shared"))


_SERIES = f"WITH n AS (SELECT DISTINCT {D.norm('name')} AS n FROM v_listing), w AS (SELECT n, {D.words('n')} AS w FROM n)"


@query("series_pairs", L, sql=f"""{_SERIES} SELECT x.n AS a, y.n AS b, x.n = y.n OR contains(x.n, y.n) OR contains(y.n, x.n) OR
  (least(len(x.w), len(y.w)) > 0 AND {D.shared('x.w', 'y.w')} >= greatest(2.0, 0.6 * least(len(x.w), len(y.w)))) AS same FROM w x JOIN w y ON x.n <= y.n AND len(list_intersect(x.w, y.w)) > 0""")
def _(t: DataFrame) -> DataFrame:
    """Names that share a word: pairs come from an equi-join on words."""
    n = t.select(N.normalize_name(c("name")).alias("n")).distinct().withColumn("w", F.explode(N.content_words(c("n"))))
    pairs = n.select(c("n").alias("a"), "w").join(n.select(c("n").alias("b"), "w"), "w").filter("a <= b").select("a", "b").distinct()
    return pairs.withColumn("same", N.same_series(c("a"), c("b")))


@query("detect_styles", "v_text", sql=f"""SELECT doc_id, array_to_string({D.styles('text', {'w1': r'\bthe\b', 'w2': r'\bof\b', 'w3': r'\bwith\b', 'w4': r'\bfrom\b'})}, ',') AS styles FROM v_text""")
def _(t: DataFrame) -> DataFrame:
    vocabulary = {"w1": r"\bthe\b", "w2": r"\bof\b", "w3": r"\bwith\b", "w4": r"\bfrom\b"}
    return t.select("doc_id", F.array_join(X.detect_styles(c("text"), vocabulary), ",").alias("styles"))


@query("topic_filter", L, sql=f"SELECT id, name FROM v_listing WHERE {D.has('name', X.TOPIC)} AND {D.has("name || ' ' || coalesce(cost, '')", X.TOPIC)}")
def _(t: DataFrame) -> DataFrame:
    """The title first, then title and text: the cheap filter leaves less for the other."""
    return t.filter(X.mentions_topic(c("name"))).filter(X.mentions_topic(F.concat_ws(" ", "name", "cost"))).select("id", "name")


@query("relevance_gate", L, "v_source", sql=f"""SELECT id, coalesce(trusted, false) OR {D.styles('name')} <> ['other'] OR {D.has('name', X.TOPIC)} AS relevant
  FROM v_listing LEFT JOIN v_source USING (source)""")
def _(t: DataFrame, s: DataFrame) -> DataFrame:
    test = F.coalesce(c("trusted"), F.lit(False)) | (X.detect_styles(c("name")) != F.array(F.lit("other"))) | X.mentions_topic(c("name"))
    return t.join(s.select("source", "trusted"), "source", "left").select("id", test.alias("relevant"))


def _duck_cost(x: str) -> str:
    parts = [f"CASE WHEN regexp_extract({x}, {D.q('(?i)' + p)}) ILIKE '%free%' THEN 'Free' ELSE nullif(trim(regexp_extract({x}, {D.q('(?i)' + p)})), '') END" for p in X.COSTS]
    return f"coalesce({', '.join(parts)}, nullif(regexp_extract({x}, '\\$\\d+'), ''), CASE WHEN {D.has(x, r'\bfree\b')} THEN 'Free' END)"


@query("extract_cost", L, sql=f"SELECT id, {_duck_cost("name || ' ' || coalesce(cost, '')")} AS price FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", X.extract_cost(F.concat(c("name"), F.lit(" "), F.coalesce("cost", F.lit("")))).alias("price"))


@query("parse_price", L, sql=r"""SELECT id, CASE WHEN trim(cost) = '' OR regexp_matches(cost, '(?i)\bfree\b') THEN 0 ELSE try_cast(regexp_extract(cost, '\$?\s*(\d+(?:\.\d{1,2})?)', 1) AS DOUBLE) END AS price FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", X.parse_price(c("cost")).cast("double").alias("price"))


@query("class_hint", L, sql=f"SELECT id, {D.has('name', X.CLASS)} AND NOT {D.has('name', X.SOCIAL)} AS hint FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", X.looks_like_class(c("name")).alias("hint"))


@query("derive_special", L, sql=f"""SELECT id, CASE WHEN ord % 11 = 0 THEN true WHEN ord % 11 = 1 THEN NULL WHEN recurring OR {D.has(D.norm('name'), X.SATELLITE)} THEN NULL
  WHEN {D.has(D.norm('name'), X.BIG_NAME)} THEN true END AS special FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    explicit = F.when(c("ord") % 11 == 0, True).when(c("ord") % 11 == 1, False)
    return t.select("id", X.derive_special(explicit, c("recurring"), c("name"), c("cost")).alias("special"))


@query("clean_location", L, sql=r"""WITH m AS (SELECT id, replace(location, ', ', chr(10) || ' , ') || CASE WHEN ord % 2 = 0 THEN chr(10) ELSE '&amp; more' END AS raw FROM v_listing)
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(replace(raw, '&amp;', '&'), '\s*[\r\n]+\s*', ', ', 'g'), '(\s*,\s*)+', ', ', 'g'), '^, |, $', '', 'g')) AS place FROM m""")
def _(t: DataFrame) -> DataFrame:
    raw = F.concat(F.replace("location", F.lit(", "), F.lit("\n , ")), F.when(c("ord") % 2 == 0, "\n").otherwise("&amp; more"))
    return t.select("id", X.clean_location(raw).alias("place"))


_STREETS = "CASE ord % 3 WHEN 0 THEN location WHEN 1 THEN replace(location, 'Main Street', 'Peña Street') ELSE replace(location, 'Main Street', 'Ångström Avenue') END"


@query("location_key", L, sql=rf"""WITH k AS (SELECT id, regexp_extract(lower({_STREETS}), '\d+\s+[\p{{L}}\p{{M}}\p{{N}}_\s]+(?:st|ave|blvd|rd|dr|ln|way|ct|pl|pkwy|drive|street|avenue)\b') AS addr FROM v_listing)
SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(nullif(addr, ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), '\bstreet\b', 'st', 'g'), '\bavenue\b', 'ave', 'g') AS place_key FROM k""")
def _(t: DataFrame) -> DataFrame:
    """Streets with letters beyond ASCII among them."""
    return t.select("id", P.location_key(F.expr(_STREETS)).alias("place_key"))


@query("geo_fence", L, sql=f"""SELECT id, CASE WHEN lat IS NULL THEN coalesce(NOT list_contains({D.array(P.NEAR_STATES)}, nullif(regexp_extract(location, ', ([A-Z][A-Z])$', 1), '')), false)
  ELSE {D.km('lat', 'lng', str(P.CENTRE[0]), str(P.CENTRE[1]))} > 50 END AS far FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", P.is_out_of_area(c("lat"), c("lng"), c("location")).alias("far"))


_HEAD = "split_part(location, ',', 1)"


@query("canonical_place", L, "v_venue", sql=f"""WITH a AS (SELECT lower(trim({_HEAD})) AS alias, id AS k, pos FROM v_venue UNION ALL SELECT lower(trim(location)), 'whole ' || id, pos + 1000000 FROM v_venue), p AS (SELECT DISTINCT lower(trim(location)) AS p FROM v_listing),
m AS (SELECT p, arg_min(k, ((p <> alias)::INT, pos)) AS place FROM p JOIN a ON contains(p, alias) GROUP BY p) SELECT id, place FROM v_listing LEFT JOIN m ON p = lower(trim(location))""")
def _(t: DataFrame, v: DataFrame) -> DataFrame:
    """The exact alias, else the first contained one. (Here a venue's name is an alias of it, its whole address one of another place.)"""
    short = v.select(F.split("location", ",")[0].alias("alias"), c("id").alias("place"), "pos")
    whole = v.select(c("location").alias("alias"), F.concat(F.lit("whole "), "id").alias("place"), (c("pos") + 1_000_000).alias("pos"))
    return PL.canonical(t, short.union(whole))


@query("infer_location", L, "v_venue", sql=f"""WITH k AS (SELECT lower({_HEAD}) AS key, location AS place, pos FROM v_venue), x AS (SELECT id, location, lower('tonight at ' || CASE WHEN ord % 3 = 0 THEN 'Hall ' || (ord % 50)::VARCHAR ELSE 'home' END || '!') AS t FROM v_listing),
m AS (SELECT t, arg_max(place, (length(key), -pos)) AS named FROM (SELECT DISTINCT t FROM x WHERE location IS NULL) JOIN k ON contains(t, key) GROUP BY t) SELECT id, coalesce(location, named) AS place FROM x LEFT JOIN m USING (t)""")
def _(t: DataFrame, v: DataFrame) -> DataFrame:
    """The location, else the longest known venue named in the text."""
    text = F.concat(F.lit("Tonight at "), F.when(c("ord") % 3 == 0, F.concat(F.lit("Hall "), (c("ord") % 50).cast("string"))).otherwise("home"), F.lit("!"))
    return PL.inferred(t, text, v.select(F.split("location", ",")[0].alias("name"), c("location").alias("place"), "pos"))


@query("lookup_place", L, "v_venue", sql=f"""WITH k AS (SELECT lower(trim({_HEAD})) AS key, pos FROM v_venue WHERE pos % 2 = 0 UNION ALL SELECT lower(trim(split_part(location, ',', 2))), pos FROM v_venue),
x AS (SELECT id, lower(trim(location)) AS a, lower(trim({_HEAD})) AS h FROM v_listing), d AS (SELECT DISTINCT a, h FROM x WHERE a IS NOT NULL),
m AS (SELECT a, coalesce(min(pos) FILTER (key = h), min(pos) FILTER (regexp_matches(' ' || h || ' ', '[^a-z0-9]' || key || '[^a-z0-9]')), min(pos) FILTER (regexp_matches(key, '^[0-9]+ ') AND regexp_matches(' ' || a || ' ', '[^a-z0-9]' || key || '[^a-z0-9]'))) AS pos FROM d, k GROUP BY a)
SELECT id, pos FROM x LEFT JOIN m USING (a)""")
def _(t: DataFrame, v: DataFrame) -> DataFrame:
    """Known places: names of halls with an even number before the first comma, street addresses anywhere."""
    names = v.filter("pos % 2 = 0").select(F.split("location", ",")[0].alias("key"), "pos")
    return PL.looked_up(t, names.union(v.select(F.split("location", ",")[1].alias("key"), "pos")))


@query("local_days", L, sql="SELECT id, start_local::DATE::VARCHAR AS day, date_diff('day', DATE '1970-01-01', start_local::DATE) AS epoch_day, dayofweek(start_local) AS dow, hour(start_local) * 60 + minute(start_local) AS clock FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    day = F.to_date("start_local")
    return t.select("id", day.cast("string").alias("day"), F.datediff(day, F.lit("1970-01-01").cast("date")).alias("epoch_day"), T.weekday(c("start_local")).alias("dow"), T.minutes_of_day(c("start_local")).alias("clock"))


_NY = "'America/New_York'"
_UTC = f"(({{x}} AT TIME ZONE {_NY}) AT TIME ZONE 'UTC')"


def _first_utc(x: str) -> str:
    """UTC clock of a New York wall clock, of two the first."""
    u = _UTC.format(x=x)
    return f"CASE WHEN (({u} - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE {_NY} = {x} THEN {u} - INTERVAL 1 HOUR ELSE {u} END"


@query("local_instants", L, sql=f"""WITH u AS (SELECT id, CASE ord % 3 WHEN 0 THEN {_first_utc('start_local')} WHEN 1 THEN start_local ELSE start_local + INTERVAL 210 MINUTE END AS utc FROM v_listing),
l AS (SELECT *, (utc AT TIME ZONE 'UTC') AT TIME ZONE {_NY} AS local FROM u), d AS (SELECT *, date_diff('minute', utc, local) AS shift, {_UTC.format(x='(local::DATE)::TIMESTAMP')} AS a, {_UTC.format(x='(local::DATE + 1)::TIMESTAMP')} AS b FROM l)
SELECT id, utc, local::DATE::VARCHAR AS day, strftime(local, '%Y-%m-%dT%H:%M:%S') || CASE shift WHEN -240 THEN '-04:00' ELSE '-05:00' END AS iso, a AS day_utc, date_diff('hour', a, b) AS hours FROM d""")
def _(t: DataFrame) -> DataFrame:
    """Starts as texts without zone, with Z, and with an offset, read as instants; their local days, which last 23 to 25 hours."""
    text = F.date_format("start_local", "yyyy-MM-dd'T'HH:mm:ss")
    at = T.parse_instant(F.when(c("ord") % 3 == 0, text).when(c("ord") % 3 == 1, F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("-03:30"))))
    day = T.local_day(at)
    bounds = T.day_bounds(day)
    first, end = T.utc_clock(bounds["first"]), T.utc_clock(bounds["end"])
    return t.select("id", T.utc_clock(at).alias("utc"), day.cast("string").alias("day"), T.iso_local(at).alias("iso"), first.alias("day_utc"), F.timestamp_diff("HOUR", first, end).alias("hours"))


@query("weekday_hist", L, sql=f"SELECT {D.day_name('start_local')} AS day, count(*) AS n FROM v_listing GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    return t.groupBy(T.weekday_name(c("start_local")).alias("day")).agg(F.count("*").alias("n"))


@query("dead_hours", L, sql="SELECT id, name FROM v_listing WHERE hour(start_local) BETWEEN 1 AND 8")
def _(t: DataFrame) -> DataFrame:
    return t.filter(T.implausible_start_hour(c("start_local"))).select("id", "name")


@query("parse_clock", "v_venue", sql=r"""WITH r AS (SELECT id, time_text, string_split_regex(time_text, '\s*[–—-]\s*') AS p FROM v_venue),
h AS (SELECT id, p, [CASE WHEN regexp_matches(x, '(?i)\d{1,2}:\d{2}\s*(AM|PM)') THEN (regexp_extract(x, '(\d{1,2}):', 1)::INT % 12
  + CASE WHEN x ILIKE '%PM' THEN 12 ELSE 0 END) * 60 + regexp_extract(x, ':(\d{2})', 1)::INT END for x in p] AS m FROM r)
SELECT id, CASE WHEN len(p) = 2 AND m[2] IS NOT NULL THEN m[1] END AS start, CASE WHEN len(p) = 2 AND m[1] IS NOT NULL THEN m[2] END AS stop FROM h""")
def _(t: DataFrame) -> DataFrame:
    r = T.parse_clock_range(c("time_text"))
    return t.select("id", r["start"].alias("start"), r["stop"].alias("stop"))


@query("nth_weekday", L, sql="""WITH d AS (SELECT id, start_local::DATE AS d, date_trunc('month', start_local)::DATE AS f, last_day(start_local::DATE) AS l, ord % 7 AS dow, ord % 6 AS n FROM v_listing),
a AS (SELECT *, f + ((dow - dayofweek(f) + 7) % 7 + (n - 1) * 7)::INT AS hit FROM d)
SELECT id, (CASE WHEN n = 0 THEN l - ((dayofweek(l) - dow + 7) % 7)::INT WHEN hit <= l THEN hit END)::VARCHAR AS day FROM a""")
def _(t: DataFrame) -> DataFrame:
    n = F.when(c("ord") % 6 == 0, -1).otherwise((c("ord") % 6).cast("int"))
    return t.select("id", T.nth_weekday(F.to_date("start_local"), (c("ord") % 7).cast("int"), n).cast("string").alias("day"))


@query("resolve_year", L, sql=f"""WITH m AS (SELECT id, ord % 12 + 1 AS m, ord % 31 + 1 AS d, DATE '{AS_OF[:10]}' AS t FROM v_listing),
y AS (SELECT *, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', year(t), m, d) AS DATE) AS a, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', year(t) + 1, m, d) AS DATE) AS b FROM m),
p AS (SELECT *, CASE WHEN a >= t - 7 THEN a ELSE b END AS pick FROM y) SELECT id, CASE WHEN pick <= t + 180 THEN pick END::VARCHAR AS day FROM p""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.resolve_year((c("ord") % 12 + 1).cast("int"), (c("ord") % 31 + 1).cast("int"), F.lit(AS_OF[:10]).cast("date")).cast("string").alias("day"))


@query("preset_ranges", L, sql="""WITH d AS (SELECT DISTINCT start_local::DATE AS today FROM v_listing), w AS (SELECT today, dayofweek(today) AS dow FROM d)
SELECT today::VARCHAR AS today, today::VARCHAR AS today_first, (today + 1)::VARCHAR AS tomorrow_first,
  (CASE WHEN dow IN (0, 5, 6) THEN today ELSE today + (5 - dow)::INT END)::VARCHAR AS weekend_first, (today + ((7 - dow) % 7)::INT)::VARCHAR AS weekend_last, (today + 6)::VARCHAR AS next7_last FROM w""")
def _(t: DataFrame) -> DataFrame:
    d = t.select(F.to_date("start_local").alias("today")).distinct()

    def at(name: str, end: str) -> Column:
        return T.preset_range(name, c("today"))[end].cast("string").alias(f"{name}_{end}")

    return d.select(c("today").cast("string").alias("today"), at("today", "first"), at("tomorrow", "first"), at("weekend", "first"), at("weekend", "last"), at("next7", "last"))


@query("time_range_kind", L, sql="""SELECT id, CASE WHEN end_local <= start_local THEN 'no_end' WHEN hour(start_local) = 0 AND hour(end_local) = 0 AND end_local::DATE > start_local::DATE THEN 'multi_day'
  WHEN end_local::DATE = start_local::DATE THEN 'same_day' WHEN date_diff('day', start_local::DATE, end_local::DATE) = 1 AND date_diff('hour', start_local, end_local) < 12 AND hour(end_local) <= 6 THEN 'same_evening'
  ELSE 'spanning' END AS kind FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.time_range_kind(c("start_local"), c("end_local")).alias("kind"))


@query("evening_fix", L, sql="""SELECT id, CASE WHEN hour(start_local) < 12 AND hour(end_local) >= 17 AND date_diff('second', start_local, end_local) >= 21600 THEN start_local + INTERVAL 12 HOUR ELSE start_local END AS fixed
  FROM (SELECT id, start_local, end_local + INTERVAL 7 HOUR AS end_local FROM v_listing)""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.evening_fix(c("start_local"), c("end_local") + F.expr("INTERVAL '7' HOUR")).alias("fixed"))


@query("move_day", L, sql="SELECT id, start_local::DATE + 9 + (start_local - date_trunc('day', start_local)) AS moved FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    """Another day, the same clock."""
    return t.select("id", F.timestamp_add("DAY", F.lit(9), c("start_local")).cast("timestamp_ntz").alias("moved"))


_LINKS = ["https://www.facebook.com/events/{i}", "https://facebook.com/events/s/x/{i}/", "https://instagram.com/p{i}", "https://fb.com/page{i}", "https://www.Eventbrite.com/e/{i}?x=1", "https://x.com/{i}", ""]


def _link() -> Column:
    options = [F.replace(F.lit(u), F.lit("{i}"), c("ord").cast("string")) for u in _LINKS]
    return F.element_at(F.array(*options, c("url")), (c("ord") % 8 + 1).cast("int"))


_DLINK = "[" + ", ".join(f"replace({D.q(u)}, '{{i}}', ord::VARCHAR)" for u in _LINKS) + ", url][ord % 8 + 1]"


@query("url_rank", L, sql=f"WITH u AS (SELECT id, {_DLINK} AS u FROM v_listing) SELECT id, {D.key('u')} AS key, {D.host('u')} AS host, {D.rank('u')} AS rank FROM u")
def _(t: DataFrame) -> DataFrame:
    u = t.select("id", _link().alias("u"))
    return u.select("id", U.url_key(c("u")).alias("key"), U.url_host(c("u")).alias("host"), U.url_rank(c("u")).alias("rank"))


@query("classify_url", L, sql=f"""WITH u AS (SELECT id, {_DLINK} AS u FROM v_listing), h AS (SELECT id, u, regexp_extract(lower(u), '^https?://([^/:?#]+)', 1) AS h FROM u)
SELECT id, CASE WHEN u = '' THEN 'no_url' WHEN contains(h, 'facebook.com') OR contains(h, 'fb.com') THEN CASE WHEN contains(lower(u), '/events/') THEN 'facebook_event' ELSE 'facebook_page' END
  WHEN contains(h, 'instagram.com') THEN 'instagram' WHEN contains(h, 'eventbrite.com') THEN 'eventbrite' WHEN h IN ('twitter.com', 'x.com', 'www.twitter.com', 'www.x.com') THEN 'social' ELSE 'direct' END AS kind FROM h""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", U.classify_url(_link()).alias("kind"))


@query("fingerprint", L, sql="""SELECT id, sha256('{"name":"' || name || '","start":"' || strftime(start_local, '%Y-%m-%d %H:%M') || '","place":"' || coalesce(location, '') || '","url":"' || url || '"}') AS print FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    """sha256 of the fields that a verification was about, in a form of their own."""
    fields = F.struct("name", F.date_format("start_local", "yyyy-MM-dd HH:mm").alias("start"), F.coalesce("location", F.lit("")).alias("place"), "url")
    return t.select("id", F.sha2(F.to_json(fields), 256).alias("print"))


@query("truncate_words", "v_text", sql=r"""WITH t AS (SELECT doc_id, text, text[1:300] AS head FROM v_text), u AS (SELECT *, regexp_extract(head, '(?s)^(.*)\s', 1) AS cut FROM t)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(CASE WHEN cut = '' THEN head ELSE cut END, '[\s,;:.\-]+$', '') || '…' END AS preview FROM u""")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", X.truncate_words(c("text"), 300).alias("preview"))


#: Tokens that overlap each other and themselves.
_TOKENS = ["the", "he", "ere", "ion", "nan"]


@query("highlight_spans", "v_text", sql=f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM v_text), k AS (SELECT unnest({D.array(_TOKENS)}) AS k), ch AS (SELECT doc_id, unnest(string_split(t, '')) AS x, generate_subscripts(string_split(t, ''), 1) - 1 AS pos FROM t),
n AS (SELECT doc_id, pos, x || lead(x, 1, '') OVER w AS two, x || lead(x, 1, '') OVER w || lead(x, 2, '') OVER w AS three FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, pos AS start, max(pos + length(k)) AS stop FROM n JOIN k ON k = two OR k = three GROUP BY 1, 2),
g AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM h),
i AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY start) AS n FROM g), s AS (SELECT doc_id, n, min(start) AS start, max(stop) AS stop FROM i GROUP BY 1, 2)
SELECT t.doc_id, coalesce(md5(string_agg(start || '-' || stop, ',' ORDER BY start)), md5('')) AS spans, count(start) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id""")
def _(t: DataFrame) -> DataFrame:
    spans = t.select("doc_id", X.highlight_spans(c("text"), _TOKENS).alias("s"))
    return spans.select("doc_id", F.md5(F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")).alias("spans"), F.size("s").cast("long").alias("n"))


@query("excerpt", "v_text", sql="SELECT doc_id, substring(text, greatest(1, instr(lower(text), 'with') - 60), 120) AS excerpt FROM v_text")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", X.excerpt_around(c("text"), "with").alias("excerpt"))


@query("display_text", "v_text", sql=r"""WITH k AS (SELECT doc_id, text, array_to_string([x for x in string_split(text, chr(10)) if NOT (regexp_matches(x, '\p{L}') AND
    length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) > 0.65 * length(regexp_replace(x, '[^\p{L}]', '', 'g')))], chr(10)) AS kept FROM v_text) SELECT doc_id, CASE WHEN trim(kept) = '' THEN text ELSE kept END AS shown FROM k""")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", X.display_text(c("text")).alias("shown"))


@query("snippet", "v_text", sql=r"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\s+', ' ', 'g')) AS p FROM v_text),
s AS (SELECT *, regexp_extract(p, '^(.{20,150}?[.!?])(\s|$)', 1) AS first, regexp_extract(p[1:150], '(?s)^(.*)\s', 1) AS cut FROM p)
SELECT doc_id, CASE WHEN length(p) <= 150 THEN p WHEN first <> '' THEN first ELSE regexp_replace(CASE WHEN cut = '' THEN p[1:150] ELSE cut END, '[\s,;:.\-]+$', '') || '…' END AS snippet FROM s""")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", X.snippet(c("text")).alias("snippet"))


@query("clock_lines", L, sql="SELECT id, 'doors ' || strftime(start_local, '%-I:%M %p') AS lines FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    text = F.concat(c("name"), F.lit("\ndoors "), F.date_format("start_local", "h:mm a"), F.lit("\nfree\ndoors "), F.date_format("start_local", "h:mm a"))
    return t.select("id", F.array_join(X.clock_lines(text), "|").alias("lines"))


@query("page_text", "v_link", sql=rf"""SELECT page_id, trim(regexp_replace({D.unescape(r"regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS body FROM v_link""")
def _(t: DataFrame) -> DataFrame:
    return t.select("page_id", X.page_text(c("html")).alias("body"))


#: What a text begins with: conditions, then mentions, with and without each other.
_NEWS = ["If it rains this will be cancelled. ", "Tonight is cancelled. If it rains tomorrow is cancelled too. ", "Note: postponed. ", "In case of snow, postponed; if not, canceled. ", "All is on. ", "Weather permitting; all that was said long before about the night, the band and the hall stays as it was: rescheduled. "]
_NEWS_SQL = f"(CASE doc_id % {len(_NEWS)} " + " ".join(f"WHEN {i} THEN {D.q(s)}" for i, s in enumerate(_NEWS)) + " END || text)"


@query("cancel_mentions", "v_text", sql=f"SELECT doc_id, {D.cancelled('t')} AS cancelled FROM (SELECT doc_id, {_NEWS_SQL} AS t FROM v_text)")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", X.cancellation_mention(F.concat(F.element_at(F.array(*map(F.lit, _NEWS)), (c("doc_id") % len(_NEWS) + 1).cast("int")), "text")).alias("cancelled"))


@query("offset_shift", L, "v_claim", sql="""SELECT l.ord, claim_no, CASE WHEN abs(abs(date_diff('second', start_local, claim_local)) - 14400) < 60 THEN 4 WHEN abs(abs(date_diff('second', start_local, claim_local)) - 18000) < 60 THEN 5 END AS shift
  FROM v_listing l JOIN v_claim ON listing_ord = l.ord""")
def _(t: DataFrame, k: DataFrame) -> DataFrame:
    return t.join(k, t.ord == k.listing_ord).select("ord", "claim_no", T.whole_offset_shift(c("start_local"), c("claim_local")).alias("shift"))


@query("render_clock", "v_claim", L, sql="""SELECT listing_ord, claim_no, claim_local IS NOT NULL AND abs(date_diff('second', claim_local, start_local + INTERVAL 10 MINUTE)) <= 900 AS is_clock FROM v_claim JOIN v_listing ON listing_ord = ord""")
def _(k: DataFrame, t: DataFrame) -> DataFrame:
    """A time within 15 minutes of the fetch is when the page was rendered."""
    fetched = c("start_local") + F.expr("INTERVAL '10' MINUTE")
    return k.join(t, k.listing_ord == t.ord).select("listing_ord", "claim_no", F.coalesce(F.abs(T.seconds_between(c("claim_local"), fetched)) <= 900, F.lit(False)).alias("is_clock"))
