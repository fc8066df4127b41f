"""Calendar rules against dateutil, and feeds of odd forms."""

import datetime as dt
import random

from brindle.operators import parse
from brindle.operators.calendar import calendar_feed, parsed_rule, rule_days
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

RULES = [
    "FREQ=DAILY", "FREQ=DAILY;INTERVAL=5", "FREQ=DAILY;BYDAY=MO,WE", "FREQ=DAILY;BYMONTH=7", "FREQ=DAILY;COUNT=30", "FREQ=WEEKLY", "FREQ=WEEKLY;BYDAY=TU,SU", "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST=SU", "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST=MO",
    "FREQ=WEEKLY;INTERVAL=3;WKST=TH;BYDAY=WE,TH", "FREQ=WEEKLY;COUNT=10;INTERVAL=2;BYDAY=MO,FR", "FREQ=MONTHLY", "FREQ=MONTHLY;BYDAY=1MO", "FREQ=MONTHLY;BYDAY=+2TU,-1FR", "FREQ=MONTHLY;BYDAY=SA", "FREQ=MONTHLY;BYMONTHDAY=13,-1,31", "FREQ=MONTHLY;INTERVAL=2;BYMONTHDAY=-2",
    "FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=1,-2;COUNT=9", "FREQ=MONTHLY;BYDAY=5WE", "FREQ=YEARLY", "FREQ=YEARLY;BYMONTH=7", "FREQ=YEARLY;BYMONTH=6,7;BYDAY=2SU",
    "FREQ=YEARLY;BYDAY=27WE", "FREQ=YEARLY;BYDAY=-24TU", "FREQ=YEARLY;BYMONTHDAY=4", "FREQ=YEARLY;BYMONTH=8;BYMONTHDAY=-1", "FREQ=YEARLY;BYDAY=TH;BYSETPOS=26,-20", "FREQ=YEARLY;INTERVAL=2;BYMONTH=7;BYDAY=TH",
]
BEGIN, END = dt.date(2026, 6, 14), dt.date(2026, 9, 6)


def test_rules_against_dateutil(spark):
    draw = random.Random(1)
    firsts = [dt.date(2026, 6, 20), dt.date(2024, 2, 29), dt.date(2025, 12, 31)] + [dt.date(2023, 1, 1) + dt.timedelta(draw.randrange(1300)) for _ in range(5)]
    rows = [(f, r) for f in firsts for r in RULES]
    df = spark.createDataFrame(rows, "first date, rule string")
    df = df.withColumn("parts", parsed_rule(F.col("rule")))
    for r in rule_days(df, F.col("first"), F.lit(BEGIN), F.lit(END)).select("first", "rule", "parts.followed", "days").collect():
        want = [x.date() for x in rrulestr(r.rule, dtstart=dt.datetime.combine(r["first"], dt.time(20))).between(dt.datetime.combine(BEGIN, dt.time()), dt.datetime.combine(END, dt.time(23)), inc=True)]
        assert r.followed and r.days == want, (r["first"], r.rule)


def feed(*entries):
    return "BEGIN:VCALENDAR\r\n" + "".join(f"BEGIN:VEVENT\r\n{e}\r\nEND:VEVENT\r\n".replace("|", "\r\n") for e in entries) + "END:VCALENDAR\r\n"


def read(spark, *texts):
    rows = calendar_feed(spark.createDataFrame(list(enumerate(texts)), "feed int, text string"), F.lit("2026-06-15 12:00:00").cast("timestamp_ntz")).collect()
    return {(r.feed, r.uid): r for r in rows}


def clocks(row):
    return [f"{d:%m%d %H%M}" for d in row.dates]


def test_until_in_all_forms(spark):
    form = "UID:a|DTSTART;TZID=America/New_York:20260701T213000|RRULE:FREQ=WEEKLY;UNTIL={}"
    got = read(spark, *(feed(form.format(u)) for u in ("20260716T013000Z", "20260716T012959Z", "20260715T213000", "20260715T212959", "20260715", "20260714", "junk")))
    assert [len(got[i, "a"].dates) for i in range(6)] == [3, 2, 3, 2, 3, 2] and len(got[6, "a"].dates) > 8
    rows = spark.createDataFrame([("x", dt.datetime(2026, 6, 1, 20), r) for r in ("FREQ=WEEKLY;UNTIL=20260706T035959Z", "FREQ=WEEKLY;UNTIL=20260705T235959", "FREQ=WEEKLY;UNTIL=20260706", "FREQ=WEEKLY;UNTIL=?")], "uid string, start timestamp_ntz, rule string")
    assert parse.feed_dates(rows, F.lit("2026-06-15").cast("timestamp_ntz")).filter("day > '2026-06-15'").count() == 2 + 2 + 3 + 12


def test_zones_exclusions_overrides_and_text(spark):
    got = read(
        spark,
        feed("UID:z|DTSTART:20260702T003000Z|DTEND:20260702T020000Z|SUMMARY:Late \\, late\\nshow|DESCRIPTION:See https://a.example/p?x=1. Or|  not|URL:fb://event?id=77"),
        feed("UID:w|DTSTART;TZID=America/Los_Angeles:20260703T190000|RRULE:FREQ=WEEKLY;COUNT=6|EXDATE;TZID=America/Los_Angeles:20260710T190000,20260717T190000|EXDATE;VALUE=DATE:20260724|RDATE;TZID=America/Los_Angeles:20260705T120000", "UID:w|RECURRENCE-ID:20260801T020000Z|DTSTART:20260802T190000|SUMMARY:Moved", "UID:w|RECURRENCE-ID;TZID=America/Los_Angeles:20260807T190000|DTSTART:20260807T190000|STATUS:CANCELLED"),
        feed("UID:d|DTSTART;VALUE=DATE:20260704", "UID:old|DTSTART:20200101T000000", "UID:none|SUMMARY:No start", "DTSTART;TZID=Mars/Base:20260704T100000|URL:fb://e?id=5", "UID:far|DTSTART:20290101T100000", "UID:hourly|DTSTART:20260704T100000|RRULE:FREQ=HOURLY", "UID:bad|DTSTART:2026-07-04"),
        None, "", "no calendar", "BEGIN:VEVENT\nUID:open\nDTSTART:20260704", feed("BEGIN:VALARM|DTSTART:20260101|END:VALARM|UID:alarm|DTSTART:20260704T1000|DTSTART:20260704T100000"),
    )
    z = got[0, "z"]
    assert clocks(z) == ["0701 2030"] and (z.stop - z.start) == dt.timedelta(minutes=90) and z.name == "Late , late\nshow" and z.url == "https://a.example/p?x=1" and not z.recurring
    rows = [r for (f, u), r in got.items() if f == 1]
    assert len(rows) == 1
    every = calendar_feed(spark.createDataFrame([(1, feed("UID:w|DTSTART;TZID=America/Los_Angeles:20260703T190000|RRULE:FREQ=WEEKLY;COUNT=6|EXDATE;TZID=America/Los_Angeles:20260710T190000,20260717T190000|EXDATE;VALUE=DATE:20260724|RDATE;TZID=America/Los_Angeles:20260705T120000", "UID:w|RECURRENCE-ID:20260801T020000Z|DTSTART:20260802T190000|SUMMARY:Moved", "UID:w|RECURRENCE-ID;TZID=America/Los_Angeles:20260807T190000|DTSTART:20260807T190000|STATUS:CANCELLED"))], "feed int, text string"), F.lit("2026-06-15 12:00:00").cast("timestamp_ntz"))
    assert sorted((r.name, *clocks(r)) for r in every.collect()) == [("Moved", "0802 1900"), ("Untitled Event", "0703 2200", "0705 1500")]
    assert clocks(got[2, "d"]) == ["0704 0000"] and (2, "old") not in got and (2, "none") not in got and (2, "bad") not in got and clocks(got[2, "far"]) == ["0101 1000"]
    own = got[2, "ics-2-3"]
    assert clocks(own) == ["0704 1000"] and own.url == "https://www.facebook.com/events/5/"
    hourly = got[2, "hourly"]
    assert clocks(hourly) == ["0704 1000"] and not hourly.followed and hourly.stop - hourly.start == dt.timedelta(hours=2)
    assert {f for f, _ in got} <= {0, 1, 2, 7} and (7, "alarm") not in got


def test_no_rule_crashes(spark):
    rules = ["", ";;", "FREQ=", "FREQ=WEEKLY;INTERVAL=0", "FREQ=WEEKLY;INTERVAL=x", "FREQ=MONTHLY;BYDAY=99XX,,", "FREQ=YEARLY;BYMONTH=13", "FREQ=DAILY;COUNT=-2", "FREQ=DAILY;COUNT=x", "FREQ=MONTHLY;BYSETPOS=0", "FREQ=WEEKLY;UNTIL=20269999T000000Z", "FREQ=WEEKLY;WKST=??"]
    got = read(spark, *(feed(f"UID:r|DTSTART:20260704T100000|RRULE:{rule}") for rule in rules))
    assert {f for f, _ in got} == {0, 1, 2, 3, 4, 8, 10, 11}


def test_feeds_of_one_file_are_spread_and_read_once(spark):
    """A file of feeds is one task, which did all the work, and entries were parsed a second time for what they replace."""
    texts = [(i, feed(f"UID:{i}|DTSTART:20260701T213000|RRULE:FREQ=WEEKLY;INTERVAL=2;COUNT=9", f"UID:{i}|RECURRENCE-ID:20260715T213000|DTSTART:20260716T200000")) for i in range(40)]
    out = calendar_feed(spark.createDataFrame(texts, "feed int, text string").coalesce(1), F.lit("2026-06-15 12:00:00").cast("timestamp_ntz"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(feed") == 1
    assert sorted((r.feed, *clocks(r)) for r in out.collect()) == sorted(x for i in range(40) for x in ((i, "0701 2130", "0729 2130", "0812 2130", "0826 2130"), (i, "0716 2000")))


def test_the_hour_skipped_in_spring_stays_as_stated(spark):
    """a clock of its own zone isn't moved, whether local, with a TZID, as an end or as an excluded date; one of another zone is told on the local clock."""
    got = read(spark, feed(
        "UID:local|DTSTART:20270314T020000|DTEND:20270314T050000", "UID:named|DTSTART;TZID=America/New_York:20270314T023000",
        "UID:end|DTSTART;TZID=America/Los_Angeles:20260307T220000|DTEND;TZID=America/Los_Angeles:20260308T023000|RRULE:FREQ=WEEKLY;COUNT=20",
        "UID:gone|DTSTART:20270313T020000|RDATE:20270314T020000|EXDATE:20270314T020000", "UID:west|DTSTART;TZID=America/Los_Angeles:20270313T233000",
    ))
    assert clocks(got[0, "local"]) == ["0314 0200"] and got[0, "local"].stop == dt.datetime(2027, 3, 14, 5)
    assert clocks(got[0, "named"]) == ["0314 0230"] and got[0, "end"].stop - got[0, "end"].start == dt.timedelta(hours=4, minutes=30)
    assert clocks(got[0, "gone"]) == ["0313 0200"] and clocks(got[0, "west"]) == ["0314 0330"]
