"""Parse jobs: raw pages, feeds, captures and submissions to rows of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unescape
from ..functions.timefn import DAYS, ZONE, nth_weekday, weekday
from .calendar import clock_of

# Month names, formats of captures, limits of a capture's age.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
FORMATS = ["yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm", "MMM d yyyy h:mm a", "d MMMM yyyy"]
EVENT_TYPES = ["Event", "DanceEvent", "MusicEvent", "SocialEvent", "Festival"]
CAPTURE_DAYS, CAPTURE_AHEAD_MINUTES = 14, 5
RULE_DAYS = ["SU", "MO", "TU", "WE", "TH", "FR", "SA"]


def jsonld_events(pages: DataFrame, types: list[str] = EVENT_TYPES) -> DataFrame:
    """page_id, name, start, place, price of the events in the pages' linked data: arrays and @graph are flattened, bad JSON is skipped."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    raw = pages.select("page_id", F.explode(blocks).alias("j")).select("page_id", F.try_parse_json("j").alias("v")).filter("v is not null")
    listed = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    one = raw.select("page_id", F.explode(listed).alias("e"))
    kind = F.coalesce(F.try_variant_get("e", "$['@type']", "array<string>"), F.array(F.try_variant_get("e", "$['@type']", "string")))
    text = lambda path: F.try_variant_get("e", path, "string")
    place = F.coalesce(F.concat_ws(", ", text("$.location.name"), text("$.location.address.streetAddress"), text("$.location.address.addressLocality")), F.lit(""))
    price = F.coalesce(text("$.offers.price"), text("$.offers[0].price"))
    kept = one.filter(F.arrays_overlap(kind, F.array(*map(F.lit, types))))
    return kept.select("page_id", unescape(text("$.name")).alias("name"), text("$.startDate").alias("start"), F.when(place == "", text("$.location")).otherwise(place).alias("place"), F.when(price.try_cast("double") == 0, "Free").when(price.isNotNull(), F.concat(F.lit("$"), price)).alias("price"))


def feed_dates(feed: DataFrame, as_of: Column, weeks: int = 12) -> DataFrame:
    """uid, day of a calendar feed (uid, start NTZ, rule text) within [as_of - 1 day, + weeks]: FREQ DAILY or WEEKLY with INTERVAL, BYDAY, UNTIL
    and COUNT. A rule of another kind gives its start alone; supported says which. An UNTIL with a time ends at its local day. calendar.calendar_feed reads whole
    feeds, with rules of all frequencies."""
    part = lambda k: F.nullif(F.regexp_extract("rule", rf"{k}=([^;]+)", 1), F.lit(""))
    rows = feed.select("uid", F.to_date("start").alias("first"), part("FREQ").alias("freq"), F.coalesce(part("INTERVAL").try_cast("int"), F.lit(1)).alias("step"), part("BYDAY").alias("by"), F.to_date(F.when(part("UNTIL").rlike("Z$"), F.convert_timezone(F.lit("UTC"), F.lit(ZONE), clock_of(part("UNTIL")))).otherwise(clock_of(part("UNTIL")))).alias("until"), part("COUNT").try_cast("int").alias("most"))
    rows = rows.withColumn("supported", F.coalesce(F.col("freq").isin("DAILY", "WEEKLY"), F.lit(False)))
    last = F.least(F.date_add(F.to_date(as_of), 7 * weeks), F.coalesce("until", F.lit("9999-12-31").cast("date")))
    # Steps count from the first date wherever the days begin; only COUNT needs all days since then.
    begin = F.when(F.col("most").isNull(), F.greatest(F.col("first"), F.date_sub(F.to_date(as_of), 1))).otherwise(F.col("first"))
    days = F.when(~F.col("supported"), F.array("first")).when(begin <= last, F.sequence(begin, F.greatest(begin, last), F.expr("INTERVAL '1' DAY"))).otherwise(F.array().cast("array<date>"))
    codes = F.array(*map(F.lit, RULE_DAYS))

    def fits(d: Column) -> Column:
        week = lambda x: F.floor(F.datediff(F.date_sub(x, F.pmod(weekday(x) + 6, F.lit(7)).cast("int")), F.lit("1970-01-05").cast("date")) / 7)
        on = F.coalesce(F.array_contains(F.split("by", ","), F.element_at(codes, F.dayofweek(d))), F.dayofweek(d) == F.dayofweek("first"))
        weekly = on & (F.pmod(week(d) - week(F.col("first")), F.col("step").cast("long")) == 0)
        return ~F.col("supported") | F.when(F.col("freq") == "DAILY", F.pmod(F.datediff(d, "first"), F.col("step")) == 0).otherwise(weekly)

    hits = F.filter(days, fits)
    hits = F.when(F.col("most").isNotNull(), F.slice(hits, 1, F.greatest(F.col("most"), F.lit(0)))).otherwise(hits)
    out = rows.select("uid", "supported", F.explode(hits).alias("day"))
    return out.filter((F.col("day") >= F.date_sub(F.to_date(as_of), 1)) & (F.col("day") <= F.date_add(F.to_date(as_of), 7 * weeks)))


def submission_dates(subs: DataFrame, as_of: Column, weeks: int = 12) -> tuple[DataFrame, DataFrame]:
    """Rows of submissions (item, recurrence_type, dow, nth, start): (item, day) with weekly, fortnightly or monthly dates ahead, and those that need a date."""
    today = F.to_date(as_of)
    days = F.filter(F.sequence(today, F.date_add(today, 7 * weeks), F.expr("INTERVAL '1' DAY")), lambda d: weekday(d) == F.col("dow"))
    fortnight = F.filter(days, lambda d: F.pmod(F.floor(F.datediff(d, F.coalesce("start", F.element_at(days, 1))) / 7), F.lit(2)) == 0)
    monthly = F.filter(days, lambda d: F.coalesce(nth_weekday(d, F.col("dow"), F.col("nth")) == d, F.lit(False)))
    once = F.when(F.col("start") >= today, F.array("start")).otherwise(F.array().cast("array<date>"))
    dates = F.when(F.col("recurrence_type") == "weekly", days).when(F.col("recurrence_type") == "biweekly", fortnight).when(F.col("recurrence_type") == "monthly", monthly).otherwise(once)
    rows = subs.withColumn("dates", dates)
    return rows.select("item", F.explode("dates").alias("day")), rows.filter(F.size("dates") == 0).select("item", F.when(F.col("start").isNull(), "no date").otherwise("past").alias("reason"))


def dates_in_text(text: Column, year: Column) -> Column:
    """Distinct dates a text names, as ISO texts, sorted: m/d/yyyy, and month names with a day and perhaps a year (else the year given)."""
    numeric = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), F.lit(1)), lambda x: F.try_to_date(x, "M/d/yyyy"))
    named = F.regexp_extract_all(F.lower(text), F.lit(rf"\b((?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*\.? \d{{1,2}}(?:st|nd|rd|th)?(?:,? \d{{4}})?)\b"), F.lit(1))

    def read(x: Column) -> Column:
        month = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(x, 1, 3))
        day, own = F.regexp_extract(x, r" (\d{1,2})", 1), F.nullif(F.regexp_extract(x, r"(\d{4})$", 1), F.lit(""))
        return F.concat_ws("-", F.coalesce(own, year.cast("string")), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")

    return F.array_sort(F.array_distinct(F.array_compact(F.concat(numeric, F.transform(named, read)))))


def preview(text: Column) -> Column:
    """struct(city, organizer, day) of `Event in C by O on Weekday, Month D YYYY`; an invalid date is null."""
    pattern = r"Event in (.+?) by (.+?) on [A-Z][a-z]+day, ([A-Z][a-z]+ \d{1,2} \d{4})"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("city"), part(2).alias("organizer"), F.try_to_date(part(3), "MMMM d yyyy").alias("day"))


def capture_reason(version: Column, captured: Column, host: Column, status: Column, events: Column, as_of: Column, hosts: list[str]) -> Column:
    """Why a capture isn't taken, ok if it is: the first rule that it breaks."""
    return (
        F.when(~version.eqNullSafe(F.lit(1)), "version").when(captured.isNull(), "no timestamp").when(captured > F.timestamp_add("MINUTE", F.lit(CAPTURE_AHEAD_MINUTES), as_of), "future")
        .when(captured < F.timestamp_add("DAY", F.lit(-CAPTURE_DAYS), as_of), "stale").when(~host.isin(hosts), "host").when((status == "empty") & (events > 0), "status").when((status == "ok") & (events == 0), "status").otherwise("ok")
    )


def read_date(text: Column) -> Column:
    """The first of several formats that a date text has."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in FORMATS))


def dated_lines(pages: DataFrame) -> DataFrame:
    """page_id, day_text, venue, city of `Day Month D - Venue - City` entries, also where they run together."""
    entry = rf"(?=(?:{'|'.join(DAYS)}) (?:{'|'.join(m.capitalize() for m in MONTHS)}) \d)"
    rows = pages.select("page_id", F.explode(F.split("text", entry)).alias("e"))
    part = lambda i: F.regexp_extract("e", r"^([A-Z][a-z]+ [A-Z][a-z]+ \d{1,2}) - (.+?) - (.+?)\s*$", i)
    return rows.select("page_id", part(1).alias("day_text"), part(2).alias("venue"), part(3).alias("city")).filter("day_text <> ''")


def heading_dates(pages: DataFrame, heading: str) -> DataFrame:
    """page_id, day_text, hours of the distinct dates that follow a heading."""
    after = F.regexp_extract("text", rf"(?is){heading}\s*(.*)", 1)
    dates = F.array_distinct(F.regexp_extract_all(after, F.lit(rf"(?i)\b((?:{'|'.join(m[:3] for m in MONTHS)})[a-z]* \d{{1,2}})\b"), F.lit(1)))
    hours = F.regexp_extract(after, r"(?i)(\d{1,2}(?::\d{2})?\s*(?:am|pm)?\s*-\s*\d{1,2}(?::\d{2})?\s*(?:am|pm))", 1)
    return pages.select("page_id", F.explode(dates).alias("day_text"), hours.alias("hours"))


def declares_empty(html: Column, widget: str = r"(?i)data-hook=\"?events", none: str = r"(?i)\"(?:count|total)\"\s*:\s*0\b") -> Column:
    """Whether a page says that it lists nothing: its widget is there, with a count of 0. A page without the widget is broken instead."""
    return F.coalesce(html.rlike(widget) & html.rlike(none), F.lit(False))
