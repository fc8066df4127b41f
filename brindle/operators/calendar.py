"""Calendar feeds: the text of a feed to its components, and their recurrence rules to dates, all in Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import detect_styles, extract_cost
from ..functions.timefn import ZONE

#: Weeks ahead that a rule is followed, and hours of an entry that states no end.
WEEKS, HOURS = 12, 2
# Codes of weekdays from Sunday, frequencies, parts of a rule that aren't followed.
CODES = ["SU", "MO", "TU", "WE", "TH", "FR", "SA"]
FREQUENCIES = ["DAILY", "WEEKLY", "MONTHLY", "YEARLY"]
UNFOLLOWED = ["BYHOUR", "BYMINUTE", "BYSECOND", "BYWEEKNO", "BYYEARDAY", "BYEASTER"]


def rule_part(rule: Column, key: str) -> Column:
    return F.nullif(F.upper(F.trim(F.regexp_extract(rule, rf"(?i)(?:^|;)\s*{key}=([^;]*)", 1))), F.lit(""))


def parsed_rule(rule: Column, frequencies: list[str] = FREQUENCIES) -> Column:
    """struct of a rule's parts; followed says whether rule_days goes by it. Make it a column of its own, as rule_days reads it many times."""
    part = lambda k: rule_part(rule, k)
    numbers = lambda k: F.transform(F.split(part(k), ","), lambda x: F.trim(x).try_cast("int"))
    step = F.coalesce(part("INTERVAL"), F.lit("1")).try_cast("int")
    by_day = lambda x: F.struct(F.array_position(F.array(*map(F.lit, CODES)), F.substring(x, -2, 2)).cast("int").alias("day"), F.nullif(F.regexp_extract(x, r"^([+-]?\d+)", 1), F.lit("")).try_cast("int").alias("n"))
    other = F.greatest(*(part(k).isNotNull() for k in UNFOLLOWED))
    week_begins = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CODES)), part("WKST")), F.lit(0)), F.lit(2)) - 2  # 0 is Monday
    return F.struct(
        part("FREQ").alias("freq"), part("COUNT").try_cast("int").alias("count"), part("UNTIL").alias("until"), F.transform(F.split(part("BYDAY"), r"\s*,\s*"), by_day).alias("by"), numbers("BYSETPOS").alias("positions"), numbers("BYMONTH").alias("months"),
        numbers("BYMONTHDAY").alias("month_days"), step.alias("step"), week_begins.alias("week_begins"), F.coalesce(part("FREQ").isin(frequencies) & (step >= 1) & ~other, F.lit(False)).alias("followed"),
    )


def rule_days(rows: DataFrame, first: Column, begin: Column, end: Column) -> DataFrame:
    """rows (with parts, a parsed rule) and days: the sorted dates of the rule from begin to end, none before first; first alone where it isn't followed.

    Days are those of the rule's periods (INTERVAL, WKST) that have its months, days of the month and weekdays (ordinals count within the month, within the
    year where a yearly rule names no month); BYSETPOS picks from each whole period, COUNT counts from first on. UNTIL is the caller's.
    """
    freq, count, by, positions, months, month_days, step, week_begins, followed = (F.col("parts")[k] for k in ("freq", "count", "by", "positions", "months", "month_days", "step", "week_begins", "followed"))
    epoch = F.lit("1970-01-05").cast("date")
    week = lambda d: F.floor((F.datediff(d, epoch) - week_begins) / 7)
    period = lambda d: F.when(freq == "DAILY", F.datediff(d, epoch)).when(freq == "WEEKLY", week(d)).when(freq == "MONTHLY", F.year(d) * 12 + F.month(d)).otherwise(F.year(d)).cast("long")
    opens = lambda d: F.when(freq == "WEEKLY", F.date_add(epoch, (week(d) * 7 + week_begins).cast("int"))).when(freq == "MONTHLY", F.trunc(d, "month")).when(freq == "YEARLY", F.trunc(d, "year")).otherwise(d)
    year_end = lambda d: F.date_sub(F.trunc(F.add_months(d, 12), "year"), 1)
    closes = lambda d: F.when(freq == "WEEKLY", F.date_add(opens(d), 6)).when(freq == "MONTHLY", F.last_day(d)).when(freq == "YEARLY", year_end(d)).otherwise(d)

    def fits(d: Column) -> Column:
        left = F.datediff(F.last_day(d), d) + 1
        of_year = (freq == "YEARLY") & months.isNull()
        from_front = F.ceil(F.when(of_year, F.dayofyear(d)).otherwise(F.day(d)) / 7)
        from_back = F.ceil(F.when(of_year, F.datediff(year_end(d), d) + 1).otherwise(left) / 7)

        def named(e: Column) -> Column:
            n = e["n"]
            return (e["day"] == F.dayofweek(d)) & (n.isNull() | freq.isin("DAILY", "WEEKLY") | (n == from_front) | (n == -from_back))

        plain = by.isNull() & month_days.isNull()
        on = F.coalesce(F.exists(by, named), F.lit(True)) & F.coalesce(F.array_contains(month_days, F.day(d)) | F.array_contains(month_days, -left), F.lit(True)) & F.coalesce(F.array_contains(months, F.month(d)), F.lit(True))
        own = (
            F.when((freq == "WEEKLY") & by.isNull(), F.dayofweek(d) == F.dayofweek(first)).when((freq == "MONTHLY") & plain, F.day(d) == F.day(first))
            .when((freq == "YEARLY") & plain, (F.day(d) == F.day(first)) & (months.isNotNull() | (F.month(d) == F.month(first)))).otherwise(F.lit(True))
        )
        return (F.pmod(period(d) - F.col("rule_first"), step.cast("long")) == 0) & own & on  # the cheapest first

    since = F.when(count.isNull(), F.greatest(first, begin)).otherwise(first)
    low, high = F.when(positions.isNull(), since).otherwise(opens(since)), F.when(positions.isNull(), end).otherwise(closes(end))
    none = F.array().cast("array<date>")
    # a rule of one day for each period is walked in its own steps from first on, any other day by day
    stride = F.when(followed, F.when(freq == "DAILY", step.cast("long")).when((freq == "WEEKLY") & by.isNull(), step.cast("long") * 7))
    ahead = F.greatest(F.datediff(low, first), F.lit(0))
    low = F.when(stride.isNotNull(), F.try_add(first, (F.ceil(ahead / stride) * stride).try_cast("int"))).otherwise(low)
    walk = F.sequence(low, F.greatest(low, high), F.make_interval(days=F.coalesce(stride, F.lit(1)).try_cast("int")))
    fitting = F.when(followed & (low <= high), F.filter(walk, fits)).otherwise(none)

    def at(d: Column, i: Column) -> Column:
        """The day, if it is at a position of its period; days are sorted, so a period's are together."""
        here = (i + 2 - F.array_position("rule_periods", F.get("rule_periods", i))).cast("int")
        n = F.size(F.filter("rule_periods", lambda p: p == F.get("rule_periods", i)))
        return F.when(F.array_contains(positions, here) | F.array_contains(positions, here - n - 1), d)

    rows = rows.withColumn("rule_first", period(first)).withColumn("rule_fitting", fitting).withColumn("rule_periods", F.when(positions.isNotNull(), F.transform("rule_fitting", period)))
    rows = rows.withColumn("rule_hits", F.when(positions.isNull(), F.col("rule_fitting")).otherwise(F.array_compact(F.transform("rule_fitting", at)))).withColumn("rule_hits", F.filter("rule_hits", lambda d: d >= first))
    counted = F.when(count.isNotNull(), F.slice("rule_hits", 1, F.greatest(count, F.lit(0)))).otherwise(F.col("rule_hits"))
    days = F.when(followed, F.filter(counted, lambda d: (d >= begin) & (d <= end))).otherwise(F.array(first))
    return rows.withColumn("days", days).drop("rule_first", "rule_fitting", "rule_periods", "rule_hits")


def properties(feeds: DataFrame) -> DataFrame:
    """feed, pos, props (name, params, value) of the entries of feeds (feed, text): folded lines are joined, parts of an entry that have parts of their own (alarms) go."""
    unfolded = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?is)(?:^|\n)BEGIN:VEVENT\s*?\n(.*?)\nEND:VEVENT"), F.lit(1))
    rows = feeds.select("feed", F.posexplode(blocks).alias("pos", "entry"))
    lines = F.split(F.regexp_replace("entry", r"(?is)BEGIN:(\w+)\s*?\n.*?END:\1", ""), r"\n")
    line = r'^([A-Za-z0-9-]+)((?:;[A-Za-z0-9-]+=(?:"[^"]*"|[^":;]*))*):(.*)\R?\z'  # matched once: name, parameters and value are set apart by line ends, which no line has
    apart = F.filter(F.transform(lines, lambda x: F.split(F.regexp_replace(x, line, "$1\n$2\n$3"), r"\n")), lambda x: F.size(x) == 3)
    prop = lambda x: F.struct(F.when(x[0].rlike("[a-z]"), F.upper(x[0])).otherwise(x[0]).alias("name"), x[1].alias("params"), F.trim(x[2]).alias("value"))
    return rows.select("feed", "pos", F.transform(apart, prop).alias("props"))


def plain_text(value: Column) -> Column:
    """A text value without its escapes."""
    for escape, to in ((r"\\[nN]", "\n"), (r"\\([,;\\])", "$1")):
        value = F.regexp_replace(value, escape, to)
    return value


def zone_of(params: Column, value: Column, known: list[str]) -> Column:
    """The zone that a time is told in: UTC for a Z, that of TZID if it is known, else ZONE."""
    named = F.regexp_replace(F.regexp_extract(params, r"(?i);TZID=([^;:]*)", 1), '"', "")
    return F.when(value.rlike("(?i)Z$"), "UTC").when(named.isin(known), named).otherwise(ZONE)


def clock_of(value: Column) -> Column:
    """The wall clock (TIMESTAMP_NTZ) that a date or time states; midnight for a date, null for anything else."""
    digits = F.regexp_extract(value, r"^(\d{8})(?:T(\d{6})?)?[Zz]?$", 1), F.regexp_extract(value, r"T(\d{6})", 1)
    return F.try_to_timestamp(F.concat(digits[0], F.when(digits[1] == "", "000000").otherwise(digits[1])), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def entry_url(url: Column, description: Column) -> Column:
    """The entry's address; one of an app gives way to the first in its description, else to the web page of the app's number. Without click ids."""
    app = url.startswith("fb://")
    number = F.regexp_extract(url, r"id=(\d+)", 1)
    page = F.when(app & (number != ""), F.concat(F.lit("https://www.facebook.com/events/"), number, F.lit("/")))
    written = F.nullif(F.regexp_replace(F.regexp_extract(description, r"https?://[^\s<>\"'\)\]]+", 0), r"[.,;!]+$", ""), F.lit(""))
    found = F.coalesce(F.nullif(F.when(~app, url), F.lit("")), written, page)
    return F.regexp_replace(F.regexp_replace(found, r"fbclid=[^&]+&?", ""), r"[?&]+$", "")


def calendar_feed(feeds: DataFrame, as_of: Column, weeks: int = WEEKS) -> DataFrame:
    """Coming entries of feeds (feed, text): feed, uid, name, start, stop, location, description, url, styles, cost, recurring, dates, followed.

    Times are told on ZONE's clock; one of its own clock stays as stated, also in the hour that is skipped in spring, and a length is that of the clocks. A rule goes by the clock of the zone its entry names; dates from a day before as_of to some weeks on count, less those
    of EXDATE and those that another entry of the uid replaces (RECURRENCE-ID); one with RDATE has these too. UNTIL ends a rule at its instant, a date
    at the end of its day. A rule that isn't followed gives its start. Entries without a start, cancelled ones and those without a coming date are left out; a null
    or broken text has no entries.
    """
    c = F.col
    zones = sorted(feeds.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    get = lambda name: F.get(F.filter("props", lambda p: p["name"] == name), F.lit(0))
    value = lambda name: get(name)["value"]
    start, stop, again = get("DTSTART"), get("DTEND"), get("RECURRENCE-ID")
    # a file of feeds may be one task, so they are spread; all that is done for a feed stays where it is dealt then
    rows = properties(feeds.repartition("feed")).select(
        "feed", F.coalesce(F.nullif(value("UID"), F.lit("")), F.concat_ws("-", F.lit("ics"), c("feed").cast("string"), "pos")).alias("uid"), "pos", "props", F.coalesce(plain_text(value("SUMMARY")), F.lit("Untitled Event")).alias("name"), F.coalesce(plain_text(value("LOCATION")), F.lit("")).alias("location"),
        F.coalesce(plain_text(value("DESCRIPTION")), F.lit("")).alias("description"), value("URL").alias("address"), value("RRULE").alias("rule"), parsed_rule(value("RRULE")).alias("parts"), clock_of(start["value"]).alias("clock"), zone_of(start["params"], start["value"], zones).alias("zone"),
        clock_of(stop["value"]).alias("stop_clock"), zone_of(stop["params"], stop["value"], zones).alias("stop_zone"), clock_of(again["value"]).alias("again_clock"), zone_of(again["params"], again["value"], zones).alias("again_zone"), (F.upper(value("STATUS")) == "CANCELLED").alias("cancelled"),
    )
    # a clock of the target's own zone stays as it is told, also one that the zone skips in spring
    to = lambda zone, clock, target=F.lit(ZONE): F.when(zone == target, clock).otherwise(F.convert_timezone(zone, target, clock))
    since, last = (as_of - F.expr("INTERVAL '24' HOUR")).cast("timestamp_ntz"), F.timestamp_add("DAY", F.lit(7 * weeks - 1), as_of).cast("timestamp_ntz")
    until_text = c("parts.until")
    until = F.when(until_text.rlike(r"^\d{8}$"), F.timestamp_add("SECOND", F.lit(86399), clock_of(until_text))).when(until_text.rlike("Z$"), to(F.lit("UTC"), clock_of(until_text), c("zone"))).otherwise(clock_of(until_text)).cast("timestamp_ntz")
    first = F.to_date("clock")
    own_last = F.date_add(F.to_date(last), 1)
    rows = rows.withColumn("until", until)
    rows = rule_days(rows, first, F.date_sub(F.to_date(since), 1), F.least(own_last, F.coalesce(F.to_date("until"), own_last)))
    seconds = F.timestamp_diff("SECOND", F.date_trunc("day", c("clock")).cast("timestamp_ntz"), c("clock"))
    at = lambda d: F.timestamp_add("SECOND", seconds.cast("int"), d.cast("timestamp_ntz")).cast("timestamp_ntz")
    listed = lambda name: F.flatten(F.transform(F.filter("props", lambda p: p["name"] == name), lambda p: F.transform(F.split(p["value"], r"\s*,\s*"), lambda v: F.struct(v.alias("v"), p["params"].alias("params")))))
    in_own = lambda x: to(zone_of(x["params"], x["v"], zones), clock_of(x["v"]), c("zone"))
    added = F.array_compact(F.transform(listed("RDATE"), in_own))
    by_rule = F.filter(F.transform("days", at), lambda t: c("until").isNull() | (t <= c("until")) | ~c("followed"))
    gone = F.array_compact(F.transform(F.filter(listed("EXDATE"), lambda x: x["v"].contains("T")), in_own))
    gone_days = F.array_compact(F.transform(F.filter(listed("EXDATE"), lambda x: ~x["v"].contains("T")), lambda x: F.to_date(clock_of(x["v"]))))
    rows = rows.withColumn("followed", c("parts.followed") | c("rule").isNull()).withColumn("gone", gone).withColumn("gone_days", gone_days).withColumn("added", added)
    clocks = F.when(c("rule").isNull(), F.array("clock")).otherwise(by_rule)
    left = F.filter(F.array_sort(F.array_distinct(F.concat(clocks, "added"))), lambda t: ~F.array_contains("gone", t) & ~F.array_contains("gone_days", F.to_date(t)))
    length = F.coalesce(F.timestamp_diff("SECOND", c("clock"), to(c("stop_zone"), c("stop_clock"), c("zone"))), F.when(c("rule").isNotNull(), HOURS * 3600), F.lit(0)).cast("int")
    rows = rows.withColumn("recurring", c("rule").isNotNull()).withColumn("dates", F.transform(left, lambda t: to(c("zone"), t))).withColumn("seconds", length)
    replaced = F.collect_set(F.when(c("clock").isNotNull() & c("feed").isNotNull(), to(c("again_zone"), c("again_clock")))).over(W.partitionBy("feed", "uid"))
    rows = rows.withColumn("replaced", replaced).filter("clock is not null")  # after the window, as a filter before it would have entries read twice
    rows = rows.withColumn("dates", F.when(c("again_clock").isNull(), F.filter("dates", lambda t: ~F.array_contains("replaced", t))).otherwise(c("dates")))
    ahead = F.filter("dates", lambda t: (t >= since) & (~c("recurring") | ~c("followed") | (t <= F.timestamp_add("DAY", F.lit(7 * weeks - 1), as_of).cast("timestamp_ntz"))))
    rows = rows.withColumn("dates", ahead).filter((F.size("dates") > 0) & ~F.coalesce("cancelled", F.lit(False))).withColumn("start", F.get("dates", F.lit(0)))
    both = F.concat_ws(" ", "name", "description")
    return rows.select(
        "feed", "uid", "name", "start", F.timestamp_add("SECOND", c("seconds"), c("start")).cast("timestamp_ntz").alias("stop"), "location", "description", entry_url(c("address"), c("description")).alias("url"), detect_styles(both).alias("styles"),
        extract_cost(both).alias("cost"), (c("recurring") | (F.size("dates") > 1)).alias("recurring"), "dates", "followed",
    )
