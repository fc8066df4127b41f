"""Columns that listings are judged by when they are paired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import WEEKDAYS, content_words, distinctive_words, normalize_name
from ..functions.places import place_text
from ..functions.text import detect_styles
from ..functions.urls import url_key

#: What a listing is judged by, as it is given, some of it only in some tables.
GIVEN = ["name", "location", "url", "start_local", "lat", "lng", "recurring", "recurrences", "hub", "canon"]
#: Columns that pairs are judged by, and ord and source.
JUDGED = ["id", "ord", "source", "hub", "canon", "norm", "words", "telling", "styles_named", "days_named", "place", "day", "key", "start_local", "lat", "lng", "recurring"]


def prepared(listings: DataFrame) -> DataFrame:
    """listings with the columns that pairs are judged by. Columns hub (venue record or not) and canon (canonical place) may be there already. Where there is a column
    recurrences (times of further nights), a row with some recurs, and all_nights has them all, its start among them, in order."""
    norm, has = normalize_name(F.col("name")), listings.columns
    if "recurrences" in has:
        nights = F.array_compact(F.coalesce("recurrences", F.array().cast("array<timestamp_ntz>")))
        dates = F.when(F.size(nights) > 0, F.array_sort(F.array_distinct(F.array_compact(F.concat(nights, F.array(F.col("start_local").cast("timestamp_ntz")))))))
        listings = listings.withColumn("all_nights", dates).withColumn("recurring", F.coalesce("recurring", F.lit(False)) | dates.isNotNull())
    hub, canon = (F.coalesce("hub", F.lit(False)) if "hub" in has else F.lit(False)), (F.nullif("canon", F.lit("")) if "canon" in has else F.lit(None).cast("string"))
    return (
        listings.withColumn("hub", hub).withColumn("canon", canon).withColumn("norm", norm).withColumn("words", content_words(F.col("norm"))).withColumn("telling", distinctive_words(F.col("words")))
        .withColumn("place", place_text(F.col("location"))).withColumn("day", F.to_date("start_local")).withColumn("key", url_key(F.col("url")))
        .withColumn("styles_named", F.array_except(detect_styles(F.col("name")), F.array(F.lit("other"))))
        .withColumn("days_named", F.array_compact(F.array(*(F.when(F.contains(F.lower("name"), F.lit(d)), F.lit(d)) for d in WEEKDAYS))))
    )


def judged_by(rows: DataFrame) -> list[str]:
    return [*JUDGED, "all_nights"] if "all_nights" in rows.columns else JUDGED
