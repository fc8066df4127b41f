"""One row of each group of copies, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_host, url_key, url_rank

#: Columns of rows to merge; those that rows lack are null.
COLUMNS = {
    "id": "string", "ord": "long", "source": "string", "source_rank": "long", "name": "string", "start_local": "timestamp_ntz", "end_local": "timestamp_ntz", "recurring": "boolean",
    "recurrences": "array<timestamp_ntz>", "schedule": "string", "location": "string", "location_override": "string", "lat": "double", "lng": "double", "description": "string", "cost": "string",
    "styles": "array<string>", "special": "boolean", "ruling": "string", "verified_at": "timestamp_ntz", "verified_status": "string", "verified_note": "string", "url": "string", "urls": "array<string>",
    "dropped_urls": "array<string>", "time_override": "struct<start_local:timestamp_ntz,end_local:timestamp_ntz>",
}
#: Taken from the first row that has one, each for itself.
_FILLED = ["schedule", "location_override", "description", "special", "ruling", "verified_at", "verified_status", "verified_note", "time_override"]


def _told(name: str) -> Column:
    """The column, null where it tells nothing."""
    kind = COLUMNS[name]
    if kind == "string":
        return F.when(F.trim(name) != "", F.col(name))
    return F.when(F.size(name) > 0, F.col(name)) if kind.startswith("array") else F.col(name)


def _beside(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what other has for the keys; a null key is a key like others."""
    named = other.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in other.columns))
    return rows.join(named, [rows[k].eqNullSafe(named[f"_{k}"]) for k in keys], "left").drop(*(f"_{k}" for k in keys))


def _dates(rows: DataFrame, group: str) -> DataFrame:
    """group, dates (start_local, end_local), recurrences of the schedule that stays."""
    c, order = F.col, F.struct("source_rank", "ord")
    late = lambda name: F.max_by(_told(name), F.when(_told(name).isNotNull(), c("ord")))
    ids = rows.groupBy(group, "id").agg(
        F.min(order).alias("at"), F.min_by("source", order).alias("source"), late("start_local").alias("start_local"), late("end_local").alias("end_local"), late("recurrences").alias("recurrences"),
        F.max(F.coalesce("recurring", F.lit(False)) | F.coalesce(F.size(_told("recurrences")) > 0, F.lit(False))).alias("series"),
    )
    facts = F.struct("start_local", "end_local", "recurrences", "source")
    first = F.struct((~c("series")).alias("single"), "at")
    last = F.struct(F.greatest(F.array_max("recurrences"), "start_local").alias("last"), "start_local", (-c("at.source_rank")).alias("rank"), (-c("at.ord")).alias("ord"))
    per = ids.groupBy(group, "source").agg(
        F.min(first).alias("first"), F.min_by(facts, first).alias("keeps"), F.max_by(facts, F.when(c("recurrences").isNotNull() & (c("source") != ""), last)).alias("freshest"),
        F.min_by(F.struct("start_local", "end_local"), "at").alias("own"), F.min("at").alias("at"), F.min_by("recurrences", F.when(c("recurrences").isNotNull(), c("at"))).alias("any"), F.min(F.when(c("recurrences").isNotNull(), c("at"))).alias("any_at"),
    )
    fresh = F.when(c("keeps.recurrences").isNotNull() & c("freshest").isNotNull(), c("freshest"))
    one = per.groupBy(group).agg(F.min_by(F.struct("keeps", fresh.alias("fresh")), "first").alias("k"), F.min_by("own", "at").alias("own"), F.min_by("any", "any_at").alias("any"))
    pick = lambda name: F.coalesce(c(f"k.fresh.{name}"), c(f"k.keeps.{name}"), *([c(f"own.{name}")] if name != "recurrences" else [c("any")]))
    return one.select(group, *(pick(n).alias(n) for n in ("start_local", "end_local", "recurrences")))


def _links(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """group, url, urls; and group, dropped_urls: of each host the first link; none that was dropped, unless nothing else is left; the fittest is url."""
    c = F.col
    all_urls = F.concat(F.array("url"), F.coalesce("urls", F.array().cast("array<string>")))
    links = rows.select(group, "source_rank", "ord", F.posexplode(all_urls).alias("pos", "link")).filter("trim(link) <> ''").withColumn("key", url_key(c("link")))
    host = F.coalesce(F.nullif(url_host(c("link")), F.lit("")), c("key"))
    order = F.struct("source_rank", "ord", "pos")
    one = links.groupBy(group, host.alias("host")).agg(F.min(order).alias("at"), F.min_by(F.struct("link", "key"), order).alias("l")).select(group, "at", "l.link", "l.key")
    gone = rows.select(group, F.explode("dropped_urls").alias("dropped")).filter("trim(dropped) <> ''").groupBy(group, url_key(c("dropped")).alias("key")).agg(F.min("dropped").alias("dropped"))
    held = _beside(one, gone.select(group, "key", F.lit(True).alias("is_gone")), [group, "key"]).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "link", F.coalesce("is_gone", F.lit(False)).alias("gone")))).alias("l"))
    live = F.filter("l", lambda x: ~x["gone"])
    stays = held.select(group, F.when(F.size(live) > 0, live).otherwise(c("l")).alias("l"))
    best = F.array_min(F.transform("l", lambda x: F.struct(url_rank(x["link"]).alias("fit"), x["at"].alias("at"), x["link"].alias("link"))))["link"]
    told = stays.withColumn("url", best).select(group, "url", F.filter(F.transform("l", lambda x: x["link"]), lambda x: x != c("url")).alias("urls"))
    dropped = gone.groupBy(group).agg(F.array_sort(F.collect_set("dropped")).alias("dropped_urls"))
    return told, dropped


def merge_rows(rows: DataFrame, group: str, ticketing: tuple[str, ...] = ()) -> DataFrame:
    """group, members and COLUMNS but ord and source_rank: one row for each group. Rows are taken by source_rank, then ord (ord is unique); the first is the
    winner and gives id, source and name. Rows without group are one group. A group may be of any size: all is combined before each shuffle, only links are listed, one for each host.

    - The schedule (start, end, recurrences) is that of the first row that is a series (recurring, or with recurrences), else the winner's. Copies of one id
      are one row there, whose dates are those that came last. Where the series' source has several with recurrences, the one that reaches furthest stays (then
      the later start, then the first). A row without recurrences takes the first there are.
    - A corrected time (time_override) of the first row that has one comes before all of this.
    - location is the winner's location_override, else the first there is; coordinates are the first pair that is whole.
    - cost is the first there is; a free one gives way to the first with a $ or from a ticketing source.
    - styles of the winner, unless they are none or just "other"; recurring if any is; the rest is filled from the first that has it.
    - Of each host the first link stays, less those that were dropped unless no other is left; the fittest is url.
    """
    c, order = F.col, F.struct("source_rank", "ord")
    whole = rows.select(group, *((c(k) if k in rows.columns else F.lit(None)).cast(v).alias(k) for k, v in COLUMNS.items()))

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), order))

    # where the winner's styles tell something they are the first that do
    free = F.lower(F.trim("cost")) == "free"
    paid = F.when(~free & (c("cost").contains("$") | F.coalesce(c("source").isin(*ticketing), F.lit(False))), c("cost")) if ticketing else F.when(~free & c("cost").contains("$"), c("cost"))
    styled = F.when((F.size("styles") > 0) & (c("styles") != F.array(F.lit("other"))), c("styles"))
    point = F.when(c("lat").isNotNull() & c("lng").isNotNull(), F.struct("lat", "lng"))
    agg = whole.groupBy(group).agg(
        F.min_by(F.struct("id", "source", "name", "location_override", "lat", "lng", "styles"), order).alias("w"), F.max(F.coalesce("recurring", F.lit(False))).alias("recurring"), first(_told("location")).alias("_location"), first(point).alias("_point"),
        first(_told("cost")).alias("_cost"), first(paid).alias("_paid"), first(styled).alias("_styles"), F.count("*").alias("members"), *(first(_told(k)).alias(k) for k in _FILLED),
    )
    dates = _dates(whole, group).select(group, F.struct("start_local", "end_local", "recurrences").alias("d"))
    out = _beside(agg, dates, [group])
    for links in _links(whole, group):
        out = _beside(out, links, [group])
    when = {k: F.coalesce(c(f"time_override.{k}"), c(f"d.{k}")) for k in ("start_local", "end_local")}
    cost = F.when(F.lower(F.trim("_cost")) == "free", F.coalesce("_paid", "_cost")).otherwise(c("_cost"))
    location = F.coalesce(F.when(F.trim("w.location_override") != "", c("w.location_override")), c("_location"))
    lat, lng = (F.when(c("_point").isNotNull(), c(f"_point.{k}")).otherwise(c(f"w.{k}")) for k in ("lat", "lng"))
    return out.select(
        group, "w.id", "w.source", "w.name", when["start_local"].alias("start_local"), when["end_local"].alias("end_local"), "recurring", c("d.recurrences").alias("recurrences"), location.alias("location"), lat.alias("lat"), lng.alias("lng"),
        cost.alias("cost"), F.coalesce("_styles", "w.styles").alias("styles"), *_FILLED, "url", "urls", "dropped_urls", "members",
    )
