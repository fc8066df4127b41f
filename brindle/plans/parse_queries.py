"""Queries of the parse jobs. The texts are derived from the tables' rows."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import DAYS
from ..operators import calendar as K
from ..operators import parse as R
from ..operators import publish as PB
from ..sources.adapters import AS_OF
from . import duck as D
from .flow_queries import _SLUGS
from .registry import query

c = F.col


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


L = "v_listing"
_NOW = f"TIMESTAMP '{AS_OF}'"


@query("jsonld_events", "v_link", sql=rf"""SELECT page_id, {D.unescape(r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[" + '"' + r"\\]', '', 'g')")} AS name, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS start, 'Hall' AS place,
  CASE WHEN page_id % 4 = 0 THEN 'Free' ELSE '$' || (page_id % 4)::VARCHAR END AS price FROM v_link WHERE page_id % 7 <> 0""")
def _(p: DataFrame) -> DataFrame:
    """The pages' titles as linked data, every fifth as a graph, every seventh broken."""
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r'["\\]', "")
    event = F.concat(F.lit('{"@type":"Event","name":"'), title, F.lit('","startDate":"2024-01-'), F.lpad((c("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit('","location":{"name":"Hall"},"offers":[{"price":"'), (c("page_id") % 4).cast("string"), F.lit('"}]}'))
    block = F.when(c("page_id") % 7 == 0, F.lit("{bad")).when(c("page_id") % 5 == 0, F.concat(F.lit('{"@graph":['), event, F.lit(",{}]}"))).otherwise(F.concat(F.lit("["), event, F.lit("]")))
    html = F.concat(c("html"), F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    return R.jsonld_events(p.withColumn("html", html))


@query("feed_recurrence", L, sql=f"""WITH f AS (SELECT id AS uid, start_local::DATE AS first, ord % 4 AS kind, ord % 3 + 1 AS step, CASE WHEN ord % 5 = 0 THEN DATE '1998-07-20' END AS until FROM v_listing),
d AS (SELECT *, unnest(generate_series(first, least(DATE '1998-09-07', coalesce(until, DATE '9999-12-31')), INTERVAL 1 DAY))::DATE AS day FROM f WHERE kind < 2 AND first <= least(DATE '1998-09-07', coalesce(until, DATE '9999-12-31'))),
h AS (SELECT uid, true AS supported, day FROM d WHERE CASE WHEN kind = 0 THEN date_diff('day', first, day) % step = 0 ELSE dayofweek(day) IN (1, 4) AND ((date_diff('day', DATE '1970-01-05', day) // 7) - (date_diff('day', DATE '1970-01-05', first) // 7)) % step = 0 END
  UNION ALL SELECT uid, false, first FROM f WHERE kind >= 2) SELECT uid, supported, day::VARCHAR AS day FROM h WHERE day BETWEEN DATE '1998-06-14' AND DATE '1998-09-07'""")
def _(t: DataFrame) -> DataFrame:
    until = F.when(c("ord") % 5 == 0, ";UNTIL=19980720").otherwise("")
    kind = F.element_at(F.array(F.lit("FREQ=DAILY"), F.lit("FREQ=WEEKLY;BYDAY=MO,TH"), F.lit("FREQ=YEARLY"), F.lit("")), (c("ord") % 4 + 1).cast("int"))
    rule = F.concat(kind, F.lit(";INTERVAL="), (c("ord") % 3 + 1).cast("string"), until)
    out = R.feed_dates(t.select(c("id").alias("uid"), c("start_local").alias("start"), rule.alias("rule")), now())
    return out.select("uid", "supported", c("day").cast("string").alias("day"))


#: Kinds of entries, by the listing's number: rule, and SQL for the days d of it from the first day f on.
_WEEK = "(date_diff('day', DATE '1970-01-05', {}) // 7)"
_KINDS = [
    ("FREQ=DAILY;INTERVAL=3;UNTIL=19980901T035959Z", "date_diff('day', f, d) % 3 = 0"),
    ("FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TH", f"dayofweek(d) IN (1, 4) AND ({_WEEK.format('d')} - {_WEEK.format('f')}) % 2 = 0"),
    ("FREQ=MONTHLY;BYDAY=2FR", "dayofweek(d) = 5 AND day(d) BETWEEN 8 AND 14"),
    ("FREQ=MONTHLY;BYDAY=-1SU;INTERVAL=2", "dayofweek(d) = 0 AND month(d + 7) <> month(d) AND (year(d) * 12 + month(d) - year(f) * 12 - month(f)) % 2 = 0"),
    ("FREQ=MONTHLY;BYMONTHDAY=15,-1", "(day(d) = 15 OR d = last_day(d))"),
    ("FREQ=YEARLY;BYMONTH=7,8;BYDAY=1SA;UNTIL=19980820", "month(d) IN (7, 8) AND dayofweek(d) = 6 AND day(d) <= 7 AND d <= DATE '1998-08-20'"),
    ("FREQ=WEEKLY;COUNT=400", "date_diff('day', f, d) % 7 = 0 AND date_diff('day', f, d) < 2800"),
    ("FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "dayofweek(d) BETWEEN 1 AND 5 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest([1, 2, 3]) AS k) WHERE dayofweek(d + k::INT) BETWEEN 1 AND 5 AND month(d + k::INT) = month(d))"),
    ("", "d = f"),
]
_CASE = lambda i: " ".join(f"WHEN {k} THEN {v[i]}" for k, v in enumerate(_KINDS))
_OWN = "CASE ord % 3 WHEN 0 THEN 3 WHEN 1 THEN -4 ELSE 0 END"


@query("calendar_feed", L, sql=f"""WITH e AS (SELECT 'F' || ord::VARCHAR AS uid, ord, ord % 9 AS kind, name, start_local AS s, start_local::DATE AS f, greatest(date_diff('second', start_local, end_local), 0) AS len FROM v_listing),
d AS (SELECT e.*, unnest(CASE WHEN kind = 8 THEN [f] ELSE generate_series(greatest(f, DATE '1998-06-10'), DATE '1998-09-12', INTERVAL 1 DAY)::DATE[] END) AS d FROM e WHERE kind = 8 OR f <= DATE '1998-09-12'),
h AS (SELECT *, d + (s - s::DATE) AS t0 FROM d WHERE CASE kind {_CASE(1)} END), x AS (SELECT *, t0 + INTERVAL 1 HOUR * ({_OWN}) AS t FROM h WHERE NOT (ord % 2 = 0 AND d = DATE '1998-07-20')),
w AS (SELECT * FROM x WHERE t >= TIMESTAMP '1998-06-14 12:00:00' AND (kind = 8 OR t <= TIMESTAMP '1998-09-06 12:00:00') AND (kind > 0 OR t <= TIMESTAMP '1998-08-31 23:59:59') AND NOT (ord % 5 = 0 AND d = DATE '1998-07-06'))
SELECT uid, min(name) AS name, min(t)::VARCHAR AS start, (min(t) + INTERVAL 1 SECOND * CASE WHEN ord % 4 = 0 THEN CASE WHEN kind = 8 THEN 0 ELSE 7200 END ELSE min(len) END)::VARCHAR AS stop, string_agg(t::VARCHAR, ' ' ORDER BY t) AS dates, 'https://cal.example/e?id=' || ord::VARCHAR AS url FROM w GROUP BY uid, ord, kind
UNION ALL SELECT uid, 'Moved', '1998-07-07 21:30:00', '1998-07-07 21:30:00', '1998-07-07 21:30:00', 'https://cal.example/e?id=' || ord::VARCHAR FROM e WHERE ord % 5 = 0""")
def _(t: DataFrame) -> DataFrame:
    """A feed for each listing, in all forms: zones, folded lines, excluded days, replaced dates, alarms, rules of all frequencies."""
    stamp = lambda x: F.date_format(x, "yyyyMMdd'T'HHmmss")
    form = lambda name, x: F.when(c("ord") % 3 == 0, F.concat(F.lit(f"{name};TZID=America/Los_Angeles:"), stamp(x))).when(c("ord") % 3 == 1, F.concat(F.lit(f"{name}:"), stamp(x), F.lit("Z"))).otherwise(F.concat(F.lit(f"{name}:"), stamp(x)))
    rule = F.element_at(F.array(*(F.lit(k) for k, _ in _KINDS)), (c("ord") % len(_KINDS) + 1).cast("int"))
    clock = F.timestamp_diff("SECOND", F.date_trunc("day", "start_local").cast("timestamp_ntz"), c("start_local")).cast("int")
    on = lambda day: F.timestamp_add("SECOND", clock, F.lit(day).cast("timestamp_ntz"))
    uid = F.concat(F.lit("UID:F"), c("ord").cast("string"))
    again = F.when(c("ord") % 5 == 0, F.concat_ws("\n", F.lit("BEGIN:VEVENT"), uid, form("RECURRENCE-ID", on("1998-07-06")), F.lit("DTSTART:19980707T213000\nSUMMARY:Moved"), F.concat(F.lit("URL:https://cal.example/e?id="), c("ord").cast("string")), F.lit("END:VEVENT")))
    text = F.concat_ws(
        "\n", F.lit("BEGIN:VCALENDAR\nVERSION:2.0\nBEGIN:VEVENT"), uid, F.concat(F.lit("SUMMARY:"), F.substring("name", 1, 4), F.lit("\n "), F.regexp_replace(F.expr("substring(name, 5)"), ",", r"\\,")), form("DTSTART", c("start_local")), F.when(c("ord") % 4 > 0, form("DTEND", F.greatest("start_local", "end_local"))),
        F.when(rule != "", F.concat(F.lit("RRULE:"), rule)), F.when(c("ord") % 2 == 0, F.when(c("ord") % 4 == 0, F.lit("EXDATE;VALUE=DATE:19980720")).otherwise(form("EXDATE", on("1998-07-20")))),
        F.lit("BEGIN:VALARM\nSUMMARY:Alarm\nDTSTART:20000101\nEND:VALARM"), F.concat(F.lit("URL:https://cal.example/e?id="), c("ord").cast("string"), F.lit("&fbclid=x1")), F.lit("END:VEVENT"), again, F.lit("END:VCALENDAR"),
    )
    out = K.calendar_feed(t.select(c("ord").alias("feed"), text.alias("text")), now())
    said = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return out.select("uid", "name", said("start").alias("start"), said("stop").alias("stop"), F.array_join(F.transform("dates", said), " ").alias("dates"), "url")


def _submissions(t: DataFrame) -> DataFrame:
    """Pending rows as submissions of all kinds."""
    kind = F.element_at(F.array(*map(F.lit, ["weekly", "biweekly", "monthly", "once"])), (c("ord") % 4 + 1).cast("int"))
    return t.filter("pool = 'pending'").select(c("id").alias("item"), kind.alias("recurrence_type"), (c("ord") % 7).cast("int").alias("dow"), (c("ord") % 4 + 1).cast("int").alias("nth"), F.when(c("ord") % 3 > 0, F.to_date("start_local")).alias("start"))


@query("submission_dates", L, sql=f"""WITH s AS (SELECT id AS item, ord % 4 AS kind, ord % 7 AS dow, ord % 4 + 1 AS nth, CASE WHEN ord % 3 > 0 THEN start_local::DATE END AS start FROM v_listing WHERE pool = 'pending'),
d AS (SELECT *, unnest(generate_series(DATE '1998-06-15', DATE '1998-09-07', INTERVAL 1 DAY))::DATE AS day FROM s), w AS (SELECT *, min(day) OVER (PARTITION BY item) AS f FROM d WHERE dayofweek(day) = dow)
SELECT item, day::VARCHAR AS day FROM w WHERE kind = 0 OR (kind = 1 AND (floor(date_diff('day', coalesce(start, f), day) / 7.0)::INT % 2 + 2) % 2 = 0) OR (kind = 2 AND (day(day) + 6) // 7 = nth)
UNION ALL SELECT item, start::VARCHAR FROM s WHERE kind = 3 AND start >= DATE '1998-06-15'""")
def _(t: DataFrame) -> DataFrame:
    return R.submission_dates(_submissions(t), now())[0].select("item", c("day").cast("string").alias("day"))


@query("submission_needs_date", L, sql="""SELECT id AS item, CASE WHEN ord % 3 = 0 THEN 'no date' ELSE 'past' END AS reason FROM v_listing WHERE pool = 'pending' AND ord % 4 = 3 AND (ord % 3 = 0 OR start_local < TIMESTAMP '1998-06-15 00:00:00')""")
def _(t: DataFrame) -> DataFrame:
    """Of all submissions, those for one date that is missing or over."""
    return R.submission_dates(_submissions(t), now())[1]


@query("dates_in_text", L, sql="""SELECT id, array_to_string(list_sort(list_distinct([start_local::DATE::VARCHAR, (start_local::DATE + 40)::VARCHAR, (start_local::DATE + 3)::VARCHAR])), ',') AS dates FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    day = F.to_date("start_local")
    text = F.concat(F.lit("From "), F.date_format(day, "M/d/yyyy"), F.lit(" and "), F.date_format(F.date_add(day, 40), "MMMM d, yyyy"), F.lit(" or 13/45/1999, "), F.date_format(F.date_add(day, 3), "MMM d yyyy"))
    return t.select("id", F.array_join(F.transform(R.dates_in_text(text, F.year(day)), lambda d: d.cast("string")), ",").alias("dates"))


@query("preview_parse", L, sql="""SELECT id, 'Boston' AS city, source AS organizer, CASE WHEN ord % 6 > 0 THEN start_local::DATE END::VARCHAR AS day FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    day = F.when(c("ord") % 6 == 0, "February 31 1998").otherwise(F.date_format("start_local", "MMMM d yyyy"))
    p = R.preview(F.concat(F.lit("Event in Boston by "), "source", F.lit(" on "), F.date_format("start_local", "EEEE"), F.lit(", "), day))
    return t.select("id", p["city"].alias("city"), p["organizer"].alias("organizer"), p["day"].cast("string").alias("day"))


@query("capture_validate", L, sql=f"""SELECT id, CASE WHEN ord % 9 = 0 THEN 'version' WHEN ord % 8 = 0 THEN 'no timestamp' WHEN start_local > {_NOW} + INTERVAL 5 MINUTE THEN 'future' WHEN start_local < {_NOW} - INTERVAL 14 DAY THEN 'stale'
  WHEN ord % 7 = 0 THEN 'host' WHEN ord % 2 = 0 AND ord % 3 > 0 THEN 'status' WHEN ord % 2 = 1 AND ord % 3 = 0 THEN 'status' ELSE 'ok' END AS reason FROM v_listing""")
def _(t: DataFrame) -> DataFrame:
    reason = R.capture_reason(F.when(c("ord") % 9 == 0, 2).otherwise(1), F.when(c("ord") % 8 != 0, c("start_local")), F.when(c("ord") % 7 == 0, "else.example").otherwise("known.example"), F.when(c("ord") % 2 == 0, "empty").otherwise("ok"), c("ord") % 3, now(), ["known.example"])
    return t.select("id", reason.alias("reason"))


@query("multi_format_dates", L, sql="SELECT id, CASE ord % 5 WHEN 3 THEN date_trunc('day', start_local)::TIMESTAMP WHEN 4 THEN NULL ELSE start_local END AS at FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    text = F.element_at(F.array(*(F.date_format("start_local", f) for f in R.FORMATS), F.lit("soon")), (c("ord") % 5 + 1).cast("int"))
    return t.select("id", R.read_date(text).alias("at"))


@query("api_flatten", L, "lineitem", sql="""SELECT id, coalesce('$' || floor(m)::INT::VARCHAR, nullif(cost, '')) AS price, coalesce(n, 0) AS details FROM v_listing LEFT JOIN (SELECT l_orderkey, min(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = ord WHERE start_local IS NOT NULL""")
def _(t: DataFrame, li: DataFrame) -> DataFrame:
    """Search hits with their details, the detail preferred."""
    d = li.groupBy(c("l_orderkey").alias("ord")).agg(F.min("l_extendedprice").alias("m"), F.count("*").alias("n"))
    j = t.filter("start_local is not null").join(d, "ord", "left")
    return j.select("id", F.coalesce(F.concat(F.lit("$"), F.floor("m").cast("string")), F.nullif("cost", F.lit(""))).alias("price"), F.coalesce("n", F.lit(0)).alias("details"))


@query("dated_lines", L, sql="SELECT ord AS page_id, strftime(start_local, '%A %B %-d') AS day_text, name AS venue, 'Boston' AS city FROM v_listing, range(2)")
def _(t: DataFrame) -> DataFrame:
    line = F.concat(F.date_format("start_local", "EEEE MMMM d"), F.lit(" - "), "name", F.lit(" - Boston"))
    return R.dated_lines(t.select(c("ord").alias("page_id"), F.concat(line, line).alias("text")))


@query("heading_dates", L, sql="SELECT ord AS page_id, unnest([strftime(start_local, '%b %-d'), strftime(start_local::DATE + 7, '%b %-d')]) AS day_text, '7-11PM' AS hours FROM v_listing")
def _(t: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Upcoming: "), F.date_format("start_local", "MMM d"), F.lit(" and "), F.date_format(F.date_add("start_local", 7), "MMM d"), F.lit(" 7-11PM $12"))
    return R.heading_dates(t.select(c("ord").alias("page_id"), text.alias("text")), "Upcoming:")


@query("page_records", L, "v_registry", sql=f"""WITH {_SLUGS}, n AS (SELECT l.id, ord, l.pool, l.recurring, l.start_local, location, name, {D.norm('name')} AS norm, slug FROM v_listing l JOIN u USING (id)),
b AS (SELECT norm, location, arg_min(slug, (start_local, ord)) AS nxt FROM n WHERE pool = 'active' GROUP BY 1, 2)
SELECT slug, name || ' — ' || CASE WHEN n.recurring THEN {D.array([d + 's' for d in DAYS])}[dayofweek(start_local) + 1] ELSE strftime(start_local, '%Y-%m-%d') END AS title, CASE WHEN pool = 'archive' THEN coalesce(nxt, slug) ELSE slug END AS canonical,
  pool = 'archive' AND NOT n.recurring AND nxt IS NULL AS noindex FROM n LEFT JOIN b ON b.norm = n.norm AND b.location = n.location""")
def _(t: DataFrame, r: DataFrame) -> DataFrame:
    """Per page: title, canonical address (an archived one's next instance), and whether search engines should leave it."""
    from ..functions.names import normalize_name
    from ..functions.timefn import weekday_name

    n = t.join(PB.unique_slugs(t), "id").withColumn("norm", normalize_name(c("name")))
    nxt = n.filter("pool = 'active'").groupBy("norm", "location").agg(F.min_by("slug", F.struct("start_local", "ord")).alias("nxt"))
    j = n.join(nxt, ["norm", "location"], "left")
    when = F.when(c("recurring"), F.concat(weekday_name(c("start_local")), F.lit("s"))).otherwise(F.date_format("start_local", "yyyy-MM-dd"))
    archived = c("pool") == "archive"
    return j.select("slug", F.concat("name", F.lit(" — "), when).alias("title"), F.when(archived, F.coalesce("nxt", "slug")).otherwise(c("slug")).alias("canonical"), (archived & ~c("recurring") & c("nxt").isNull()).alias("noindex"))
