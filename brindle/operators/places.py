"""Places by tables: canonical names of aliases, venues named in a text, coordinates of feed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import place_text

_TOKEN = r"[\p{L}\p{N}]+"


def held(texts: DataFrame, keys: DataFrame, whole: bool = False) -> DataFrame:
    """Distinct texts (text) with each key (key and other columns) that they hold, at token boundaries if whole.

    A text's three-letter pieces meet the keys' first three letters, or its tokens the keys' first token, in one equi-join; neither side has to be small.
    """
    t, k = F.col("text"), F.col("key")
    if whole:
        heads, pieces = F.regexp_extract(k, _TOKEN, 0), F.array_distinct(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)))
    else:
        heads = F.substring(k, 1, 3)
        pieces = F.array_distinct(_grams(t))
    rows = texts.select("text").filter("text is not null").distinct().withColumn("_p", F.explode(pieces))
    known = keys.filter("key <> ''").withColumn("_p", heads)
    found = rows.join(known, "_p").drop("_p").filter(F.contains(t, k)).distinct()
    if not whole:
        return found
    edge = lambda x: ~F.coalesce(x.rlike(r"^[\p{L}\p{N}]$"), F.lit(False))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t) - F.length(k) + 1, F.lit(1))), lambda i: t.substr(i, F.length(k)) == k)
    free = lambda i: edge(F.when(i > 1, t.substr(i - 1, F.lit(1)))) & edge(F.nullif(t.substr(i + F.length(k), F.lit(1)), F.lit("")))
    return found.filter(F.exists(starts, free))


def _grams(t: Column) -> Column:
    """Pieces of one to three letters: a key shorter than three is its own head."""
    at = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
    return F.concat(F.transform(at, lambda i: t.substr(i, F.lit(1))), F.transform(at, lambda i: t.substr(i, F.lit(2))), F.transform(at, lambda i: t.substr(i, F.lit(3))))


def canonical(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, place: by aliases (alias, place, pos) the exact one of the location's text, else the first, in pos, that it contains; null if none."""
    rows = listings.select("id", place_text(F.col("location")).alias("text"))
    keys = aliases.select(F.lower(F.trim("alias")).alias("key"), "place", "pos")
    per = held(rows, keys).groupBy("text").agg(F.min_by("place", F.struct((F.col("text") != F.col("key")).cast("int"), "pos")).alias("place"))
    return rows.join(per, "text", "left").select("id", "place")


def inferred(listings: DataFrame, text: Column, venues: DataFrame) -> DataFrame:
    """id, place: the location, else what follows a pin mark in a text, else the longest venue (name, place, pos) named in it."""
    rows = listings.select("id", "location", F.lower(text).alias("text"), F.nullif(F.trim(F.regexp_extract(text, "\U0001f4cd([^\\n]+)", 1)), F.lit("")).alias("pinned"))
    keys = venues.groupBy(F.lower("name").alias("key")).agg(F.min_by("place", "pos").alias("place"), F.min("pos").alias("pos"))  # of venues of one name the first is named
    told, asking = rows.filter("coalesce(location, pinned) is not null"), rows.filter("coalesce(location, pinned) is null")  # a text that many rows have is joined for those alone that need it
    per = held(asking, keys).groupBy("text").agg(F.max_by("place", F.struct(F.length("key"), -F.col("pos"))).alias("named"))
    return told.select("id", F.coalesce("location", "pinned").alias("place")).union(asking.join(per, "text", "left").select("id", F.col("named").alias("place")))


def looked_up(listings: DataFrame, known: DataFrame) -> DataFrame:
    """id, pos of the known place (key, pos) that a location names: its whole text before the first comma, else a key there at token boundaries, else a
    key with a number (an address) anywhere; the first in pos."""
    low = F.lower(F.trim("location"))
    rows = listings.select("id", low.alias("all"), F.trim(F.split(low, ",")[0]).alias("head"))
    keys = known.select(F.lower(F.trim("key")).alias("key"), "pos")
    exact = keys.groupBy(F.col("key").alias("head")).agg(F.min("pos").alias("exact"))
    in_head = held(rows.select(F.col("head").alias("text")), keys, whole=True).groupBy(F.col("text").alias("head")).agg(F.min("pos").alias("within"))
    in_all = held(rows.select(F.col("all").alias("text")), keys.filter(F.col("key").rlike(r"^\d+ ")), whole=True).groupBy(F.col("text").alias("all")).agg(F.min("pos").alias("address"))
    out = rows.join(exact, "head", "left").join(in_head, "head", "left").join(in_all, "all", "left")
    return out.select("id", F.coalesce("exact", "within", "address").alias("pos"))


def geo_by_uid(feed: DataFrame, points: DataFrame, geocoded: DataFrame) -> DataFrame:
    """feed (uid, location, ...) with lat, lng: those of points (uid), else of geocoded (location)."""
    by_uid = points.select("uid", F.struct("lat", "lng").alias("_u"))
    by_text = geocoded.select(place_text(F.col("location")).alias("_t"), F.struct("lat", "lng").alias("_g"))
    rows = feed.withColumn("_t", place_text(F.col("location"))).join(by_uid, "uid", "left").join(by_text, "_t", "left")
    at = F.coalesce("_u", "_g")
    return rows.withColumn("lat", at["lat"]).withColumn("lng", at["lng"]).drop("_t", "_u", "_g")
