"""Dates, clocks and occurrences in local wall-clock time (TIMESTAMP_NTZ). All are Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of weekdays from Sunday, default phase of fortnightly schedules, hours that no event starts at.
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
DEFAULT_ANCHOR = "2026-01-02"
DEAD_HOURS = (1, 8)


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds on the local clock."""
    return F.timestamp_diff("SECOND", a, b)


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def weekday_name(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(ts))


def minutes_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def implausible_start_hour(ts: Column) -> Column:
    return F.hour(ts).between(*DEAD_HOURS)


def parse_clock(text: Column) -> Column:
    """Minutes of the day of `9:00 PM` or `21:00`, else null."""
    h, m, half = (F.regexp_extract(text, r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)", i) for i in (1, 2, 3))
    twelve = (F.try_to_number(h, F.lit("99")).cast("int") % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0)) * 60 + F.try_to_number(m, F.lit("99")).cast("int")
    h24, m24 = (F.try_to_number(F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", i), F.lit("99")).cast("int") for i in (1, 2))
    return F.when(h != "", twelve).when((h24 < 24) & (m24 < 60), h24 * 60 + m24)


def parse_clock_range(text: Column) -> Column:
    """struct(start, stop) in minutes of the day, null unless both sides of one dash are clocks."""
    parts = F.split(text, r"\s*[–—-]\s*")
    start, stop = parse_clock(F.get(parts, F.lit(0))), parse_clock(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & start.isNotNull() & stop.isNotNull(), F.struct(start.alias("start"), stop.alias("stop")))


def nth_weekday(day: Column, dow: Column, n: Column) -> Column:
    """The n-th weekday dow (0 is Sunday) of the day's month, n = -1 the last; null if the month has none."""
    first = F.trunc(day, "month")
    at = F.date_add(first, F.pmod(dow - weekday(first), F.lit(7)).cast("int") + (n.cast("int") - 1) * 7)
    last = F.last_day(day)
    final = F.date_sub(last, F.pmod(weekday(last) - dow, F.lit(7)).cast("int"))
    return F.when(n == -1, final).when((n >= 1) & (at <= last), at)


def schedule_admits(day: Column, note: Column, dow: Column, starts: Column, until: Column, anchor: Column | None = None) -> Column:
    """Whether a weekly entry takes place on a day of its weekday: within its bounds, the n-th of the month if the note says so, every other week from the anchor if it says that."""
    low = F.lower(F.coalesce(note, F.lit("")))
    nth = F.try_to_number(F.regexp_extract(low, r"(\d)(?:st|nd|rd|th)\s+\w+day", 1), F.lit("9")).cast("int")
    ref = F.coalesce(anchor, F.lit(DEFAULT_ANCHOR).cast("date")) if anchor is not None else F.lit(DEFAULT_ANCHOR).cast("date")
    even = F.pmod(F.floor(F.datediff(day, ref) / 7), F.lit(2)) == 0
    fits = F.when(nth.isNotNull(), F.coalesce(nth_weekday(day, dow, nth) == day, F.lit(False))).when(low.contains("every other") | low.contains("alternating"), even).otherwise(True)
    return F.coalesce(day >= starts, F.lit(True)) & F.coalesce(day <= until, F.lit(True)) & fits


def resolve_year(month: Column, day: Column, as_of: Column, grace: int = 7, ahead: int = 180) -> Column:
    """The date of a month and day without year: this year's, or next year's if that is past the grace; null if too far ahead or no date."""
    this, following = F.try_make_date(F.year(as_of), month, day) if hasattr(F, "try_make_date") else _try_date(F.year(as_of), month, day), _try_date(F.year(as_of) + 1, month, day)
    pick = F.when(this >= F.date_sub(as_of, grace), this).otherwise(following)
    return F.when(pick <= F.date_add(as_of, ahead), pick)


def _try_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return text.try_cast("date")


def preset_range(name: str, today: Column) -> Column:
    """struct(first, last) of today, tomorrow, weekend (Friday to Sunday, what is left of it), next7; all is open."""
    dow = F.dayofweek(today)  # 1 is Sunday
    to_friday = F.pmod(F.lit(6) - dow, F.lit(7)).cast("int")
    friday = F.when(dow.isin(1, 7, 6), today).otherwise(F.date_add(today, to_friday))
    sunday = F.date_add(today, F.pmod(F.lit(8) - dow, F.lit(7)).cast("int"))
    none = F.lit(None).cast("date")
    first, last = {"today": (today, today), "tomorrow": (F.date_add(today, 1),) * 2, "weekend": (friday, sunday), "next7": (today, F.date_add(today, 6)), "all": (none, none)}[name]
    return F.struct(first.alias("first"), last.alias("last"))


def time_range_kind(start: Column, stop: Column) -> Column:
    """How the times of a listing read: no_end, multi_day (whole days, exclusive end), same_day, same_evening (past midnight, under 12 hours, over by 6), spanning."""
    midnight = (minutes_of_day(start) == 0) & (minutes_of_day(stop) == 0)
    days, hours = F.datediff(stop, start), seconds_between(start, stop) / 3600
    return (
        F.when(stop.isNull() | (stop <= start), "no_end").when(midnight & (days >= 1), "multi_day").when(days == 0, "same_day")
        .when((days == 1) & (hours < 12) & (minutes_of_day(stop) <= 360), "same_evening").otherwise("spanning")
    )


def whole_offset_shift(a: Column, b: Column) -> Column:
    """4 or 5 where two times are that many hours apart, to a minute: one was read in another zone."""
    gap = F.abs(seconds_between(a, b))
    return F.when(F.abs(gap - 14400) < 60, 4).when(F.abs(gap - 18000) < 60, 5)


def evening_fix(start: Column, stop: Column) -> Column:
    """A morning start with an evening end six hours later or more was meant twelve hours later."""
    wrong = (F.hour(start) < 12) & (F.hour(stop) >= 17) & (seconds_between(start, stop) >= 6 * 3600)
    return F.when(wrong, start + F.expr("INTERVAL '12' HOUR")).otherwise(start)


def occurrence_instants(*times: Column) -> Column:
    """Distinct times of arrays, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*times))))


def display_start(occurrences: Column, as_of: Column) -> Column:
    """The first occurrence from midnight of as_of on, else the first of all."""
    return F.coalesce(F.array_min(F.filter(occurrences, lambda t: t >= F.date_trunc("day", as_of).cast("timestamp_ntz"))), F.array_min(occurrences))


#: The zone of times that name none.
ZONE = "America/New_York"
_OFFSET = r"(?i)(Z|[+-]\d{2}(?::?\d{2})?)$"


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_clock(instant: Column) -> Column:
    """The UTC wall clock (TIMESTAMP_NTZ) of an instant (TIMESTAMP), whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch()).cast("timestamp_ntz")


def _at_utc(clock: Column) -> Column:
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), clock))


def instant_of(local: Column, zone: str = ZONE) -> Column:
    """The instant of a wall clock. One that occurs twice when clocks go back is the first; one that is skipped moves on by the hour that is lost."""
    return _at_utc(F.convert_timezone(F.lit(zone), F.lit("UTC"), local))


def local_of(instant: Column, zone: str = ZONE) -> Column:
    """The wall clock (TIMESTAMP_NTZ) of an instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_clock(instant))


def parse_instant(text: Column, zone: str = ZONE) -> Column:
    """The instant of an ISO text: with Z or an offset as it says, without on the zone's wall clock. Null for anything else."""
    mark = F.regexp_extract(text, _OFFSET, 1)
    has_time = text.rlike(r"\d[T ]\d{1,2}:")
    naive = F.regexp_replace(text, F.lit(_OFFSET), F.lit(""))
    zoned = has_time & (mark != "")
    clock = F.when(zoned, naive).otherwise(text).try_cast("timestamp_ntz")
    digits = F.rpad(F.regexp_replace(mark, "[^0-9]", ""), 4, "0")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    shift = F.when(F.upper(mark) == "Z", 0).when(mark.startswith("-"), minutes).otherwise(-minutes)
    return F.when(zoned, _at_utc(F.timestamp_add("MINUTE", shift, clock).cast("timestamp_ntz"))).otherwise(instant_of(clock, zone))


def iso_local(instant: Column, zone: str = ZONE) -> Column:
    """`2026-07-01T20:00:00-04:00`: the wall clock with its offset."""
    local = local_of(instant, zone)
    offset = F.timestamp_diff("MINUTE", utc_clock(instant), local)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    sign = F.when(offset < 0, "-").otherwise("+")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, two(F.floor(F.abs(offset) / 60)), F.lit(":"), two(F.abs(offset) % 60))


def local_day(instant: Column, zone: str = ZONE) -> Column:
    return F.to_date(local_of(instant, zone))


def day_bounds(day: Column, zone: str = ZONE) -> Column:
    """struct(first, end): the instants at which a local day begins and the next one does; 23 to 25 hours apart."""
    midnight = lambda d: instant_of(d.cast("timestamp_ntz"), zone)
    return F.struct(midnight(day).alias("first"), midnight(F.date_add(day, 1)).alias("end"))
