"""Readers of the registry's files: sources, aliases, venues, submissions, fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = "id string, name string, type string, scraper string, enabled boolean, trusted boolean, unreliable boolean, noise double, organizer string, active_months array<int>"
VENUES = "id string, name string, location string, lat double, lng double, styles array<string>, excludeDates array<string>, nextDateApproximate boolean, schedule array<struct<dayOfWeek:string,time:string,note:string,anchor:string,starts:string,until:string>>"
SUBMISSIONS = "event_name string, event_url string, styles array<string>, location string, is_recurring boolean, date string, time string, recurrence_type string, day_of_week string, week_of_month string, start_date string, notes string, email string"
PAGES = "url string, source_id string, status int, body string, fetched_at timestamp"
#: Allowed values of a submission's recurrence.
RECURRENCES = ["once", "weekly", "biweekly", "monthly"]


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry of sources with its place in the file as rank: the earlier source wins a merge. Sources that aren't enabled stay, marked."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"sources array<struct<{_fields(SOURCES)}>>", {"mode": "FAILFAST"}).alias("r")).select("r.sources")
    out = rows.select(F.posexplode("sources").alias("source_rank", "s")).select("source_rank", "s.*")
    return out.fillna(False, ["enabled", "trusted", "unreliable"])


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, place, pos of a map from a place to its aliases, in the file's order; keys that begin with _ are notes."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    each = text.select(F.posexplode(F.map_entries("m")).alias("i", "e")).select("i", F.col("e.key").alias("place"), F.from_json("e.value", "array<string>").alias("aliases")).filter(~F.col("place").startswith("_"))
    flat = each.select("place", "i", F.posexplode(F.concat(F.array("place"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("j", "alias"))
    return flat.select(F.lower(F.trim("alias")).alias("alias"), "place", (F.col("i") * F.lit(1 << 20) + F.col("j")).alias("pos"))


def load_venues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Venues with their place in the file (pos), and a row for each entry of their schedules: id, pos, day_of_week, time_text, note, anchor, starts, until_date."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_fields(VENUES)}>>").alias("v"))
    venues = rows.select(F.posexplode("v").alias("pos", "v")).select("pos", "v.*")
    e = venues.select("id", "pos", F.explode("schedule").alias("s"))
    return venues, e.select("id", "pos", F.col("s.dayOfWeek").alias("day_of_week"), F.col("s.time").alias("time_text"), F.coalesce("s.note", F.lit("")).alias("note"), F.col("s.anchor").try_cast("date").alias("anchor"), F.col("s.starts").try_cast("date").alias("starts"), F.col("s.until").try_cast("date").alias("until_date"))


def _fields(ddl: str) -> str:
    """`a string, b array<...>` as fields of a struct: `a:string, b:array<...>`."""
    out, depth = [], 0
    name = True
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == " " and name and depth == 0 and out and out[-1] not in ", ":
            out.append(":")
            name = False
        else:
            out.append(ch)
            if ch == "," and depth == 0:
                name = True
    return "".join(out)


def read_submissions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Submissions of an inbox folder of JSON files, as (valid, refused with reason): a name is needed, recurrence and date are of the allowed forms.
    As a stream, read the folder with the same schema and cleanSource=archive."""
    rows = spark.read.schema(SUBMISSIONS + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder).withColumn("file", F.col("_metadata.file_name"))
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "no JSON").when(F.trim(F.coalesce("event_name", F.lit(""))) == "", "no name").when(~F.coalesce("recurrence_type", F.lit("once")).isin(RECURRENCES), "recurrence")
        .when(F.col("date").isNotNull() & (F.col("date") != "") & F.col("date").try_cast("date").isNull(), "date")
    )
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason", "_corrupt"), marked.filter("reason is not null").select("file", "reason")


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages already fetched: url, source_id, status, body, fetched_at; the last fetch of a URL."""
    rows = spark.read.schema(PAGES).parquet(path)
    return rows.groupBy("url").agg(F.max_by(F.struct("source_id", "status", "body", "fetched_at"), F.struct("fetched_at", "status")).alias("p")).select("url", "p.*")


def off_season(active_months: Column, as_of: Column) -> Column:
    """Whether a source has no season in the month; one without months always has."""
    return F.coalesce((F.size(active_months) > 0) & ~F.array_contains(active_months, F.month(as_of)), F.lit(False))
