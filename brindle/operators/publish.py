"""Publishing: the feed, its slices and pages, unique slugs, the volume tripwire, the register of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import content_words, is_ascii, normalize_name, to_ascii
from ..functions.text import detect_styles, parse_price
from ..functions.timefn import display_start, parse_clock_range, seconds_between
from . import copies, match, series
from . import venues as venue_dates
from .stage import kept

#: The tripwire: refuse below this share of the previous number of rows, where that was at least so many.
LEAST_SHARE, LEAST_ROWS = 0.7, 20


def _kebab(text: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60)


def slug_base(name: Column) -> Column:
    """Kebab case of a name's ASCII letters and digits, at most 60 characters."""
    return _kebab(to_ascii(name))


def unique_slugs(listings: DataFrame, owners: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, slug (and columns of carry): the base and the id's first eight characters. Of rows with one slug, that which the register (owners: slug, id) knows it by
    keeps it, else the smallest id; the others have the first eight of their id's md5 instead. A slug's totals are joined, not its rows gathered; only names that
    aren't ASCII pass through Python."""
    c = F.col
    named = listings.select("id", "name", *(x for x in carry if x not in ("id", "name")))
    plain = F.coalesce(is_ascii(c("name")), F.lit(True))
    rows = named.filter(plain).withColumn("base", _kebab(c("name"))).union(named.filter(~plain).withColumn("base", slug_base(c("name"))))
    rows = rows.withColumn("slug", F.concat_ws("-", "base", F.lower(F.substring("id", 1, 8))))
    if owners is None:
        rows = rows.withColumn("owner", F.lit(None).cast("string"))
    else:
        rows = rows.join(owners.groupBy("slug").agg(F.min("id").alias("owner")), "slug", "left")
    per = rows.groupBy("slug").agg(F.coalesce(F.min(F.when(c("id") == c("owner"), c("id"))), F.min("id")).alias("keeper"))
    other = F.concat_ws("-", "base", F.substring(F.md5(c("id").cast("binary")), 1, 8))
    slug = F.when(c("id") == c("keeper"), c("slug")).otherwise(other).alias("slug")
    return rows.join(per, "slug").select("id", slug, *(x for x in carry if x != "id"))


def feed(listings: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Published columns of active and archived rows of reliable sources: id, name, start, place, organizer, styles, price, archived."""
    kept = listings.filter("pool in ('active', 'archive')").join(sources.filter("unreliable").select("source"), "source", "left_anti")
    named = kept.join(sources.select("source", "organizer"), "source", "left")
    return named.select(
        "id", "name", F.col("start_local").alias("start"), F.coalesce("location", F.lit("")).alias("place"), "organizer", F.array_join(detect_styles(F.col("name")), ",").alias("styles"),
        parse_price(F.col("cost")).cast("double").alias("price"), ((F.col("pool") == "archive") | (F.col("start_local") < as_of)).alias("archived"),
    )


#: Weeks ahead for which venue nights are expanded; clock and hours of a night without either.
WEEKS_AHEAD, DEFAULT_START, DEFAULT_HOURS = 8, 20 * 60, 3
_ROW = ["id", "ord", "hub", "source", "source_rank", "name", "start_local", "end_local", "location", "lat", "lng", "cost", "url", "recurring"]


def venue_rows(nights: DataFrame) -> DataFrame:
    """A row per venue of its nights (id, pos, name, location, time_text, day): the next one, with its clock; past midnight it ends the next day."""
    c = F.col
    span = parse_clock_range(c("time_text"))
    start = F.timestamp_add("MINUTE", F.coalesce(span["start"], F.lit(DEFAULT_START)), c("day").cast("timestamp_ntz")).cast("timestamp_ntz")
    length = F.coalesce(F.pmod(span["stop"] - span["start"] - 1, F.lit(1440)) + 1, F.lit(DEFAULT_HOURS * 60)).cast("int")
    first = nights.groupBy("id").agg(F.min(F.struct("day", "pos", "name", "location", "time_text")).alias("n")).select("id", "n.*").withColumn("start_local", start)
    none = lambda t: F.lit(None).cast(t)
    return first.select(
        "id", (c("pos") - F.lit(1 << 60)).alias("ord"), F.lit(True).alias("hub"), F.lit("venues").alias("source"), F.lit(-1).alias("source_rank"), "name", "start_local",
        F.timestamp_add("MINUTE", length, c("start_local")).cast("timestamp_ntz").alias("end_local"), "location", none("double").alias("lat"), none("double").alias("lng"), none("string").alias("cost"), none("string").alias("url"), F.lit(True).alias("recurring"),
    )


def compose(listings: DataFrame, venues: DataFrame, sources: DataFrame, as_of: Column, excluded: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """What a publish ships, in the order of starts: id, name, start, stop, place, lat, lng, price, styles, url, dates, members, archived, search_only, slug.

    Live rows of reliable sources, without those that fold into a venue's night, and the regular venues' next nights: certain pairs become one row, series
    one row with all dates, a stale start moves to the next date and its end with it. Archived rows follow as they are, and venues without fixed dates that
    no coming live row covers, without a start. excluded: id, day of nights that don't take place. Slugs are unique over all of them.
    """
    c = F.col
    today = F.to_date(as_of)
    nights = venue_dates.expand(venues, today, F.date_add(today, 7 * WEEKS_AHEAD - 1))
    if excluded is not None:
        nights = nights.join(excluded, ["id", "day"], "left_anti")
    fixed, loose = nights.filter("not coalesce(approximate, false)"), venues.filter("coalesce(approximate, false)")
    reliable = listings.join(sources.filter("unreliable").select("source"), "source", "left_anti").join(sources.select("source", "source_rank"), "source", "left")
    live = reliable.filter("pool = 'active'").withColumn("source_rank", F.coalesce("source_rank", F.lit(1 << 30))).withColumn("hub", F.lit(False))
    folded = venue_dates.verdicts(venue_dates.overlaps(venue_dates.collisions(live, venue_dates.first_nights(fixed)))).filter("verdict = 'fold'").select("id")
    rows = kept(venue_rows(fixed).select(*_ROW).unionByName(live.join(folded, "id", "left_anti").select(*_ROW)))
    same = copies.certain_groups(rows)
    grouped = rows.join(same, rows.id == same.node, "left").withColumn("g", F.coalesce("group", "id"))
    one = match.merged(grouped, "g", carry=("ord", "hub", "end_local"))
    one = kept(one.select("id", "ord", "hub", "name", "start_local", "end_local", "location", "lat", "lng", "cost", "url", "recurring", "members"))
    led = one.join(series.leaders(one), "id")
    order = F.struct("ord")
    first = {k: F.min_by(k, F.when(c(k).isNotNull(), order)).alias(k) for k in ("location", "lat", "lng", "cost", "url")}
    own = F.min_by(F.struct("id", "name", "start_local", "end_local"), order)
    whole = led.groupBy("leader").agg(own.alias("o"), *first.values(), F.sum("members").alias("members"), F.array_sort(F.collect_set("start_local")).alias("dates"))
    start = F.coalesce(display_start(c("dates"), as_of), c("o.start_local"))
    moved = F.timestamp_diff("MICROSECOND", c("o.start_local"), start)
    stop = F.timestamp_add("MICROSECOND", moved, c("o.end_local")).cast("timestamp_ntz")
    some = lambda t: [t[k] if k in t else c(k) for k in ("location", "lat", "lng", "cost", "url")]
    no = F.lit(False)
    out = whole.select(c("o.id").alias("id"), c("o.name").alias("name"), start.alias("start"), stop.alias("stop"), *some({}), "dates", "members", no.alias("archived"), no.alias("search_only"))
    none = F.array().cast("array<timestamp_ntz>")
    past = reliable.filter("pool = 'archive'").select("id", "name", c("start_local").alias("start"), c("end_local").alias("stop"), *some({}), none.alias("dates"), F.lit(1).cast("long").alias("members"), F.lit(True).alias("archived"), no.alias("search_only"))
    covered = live.filter(c("start_local") >= as_of).select("location").distinct()
    no_time, no_point, no_text = (F.lit(None).cast(t) for t in ("timestamp_ntz", "double", "string"))
    bare = {"lat": no_point.alias("lat"), "lng": no_point.alias("lng"), "cost": no_text.alias("cost"), "url": no_text.alias("url")}
    ghosts = loose.join(covered, "location", "left_anti").select("id", "name", no_time.alias("start"), no_time.alias("stop"), *some(bare), none.alias("dates"), F.lit(1).cast("long").alias("members"), no.alias("archived"), F.lit(True).alias("search_only"))
    everything = kept(out.unionByName(past).unionByName(ghosts))
    named = everything.join(unique_slugs(everything, owners), "id")
    shown = named.select(
        "id", "name", "start", "stop", F.coalesce("location", F.lit("")).alias("place"), "lat", "lng", parse_price(c("cost")).cast("double").alias("price"), F.array_join(detect_styles(c("name")), ",").alias("styles"),
        "url", "dates", "members", "archived", "search_only", "slug",
    )
    return shown.orderBy(F.col("start").asc_nulls_last(), "id")


def tripwire(now: DataFrame, before: DataFrame) -> DataFrame:
    """n_now, n_before, refuse: whether too few rows are left to publish."""
    a, b = now.agg(F.count("*").alias("n_now")), before.agg(F.count("*").alias("n_before"))
    return a.join(b).withColumn("refuse", (F.col("n_before") >= LEAST_ROWS) & (F.col("n_now") < F.col("n_before") * LEAST_SHARE))


def record(register: DataFrame, published: DataFrame, at: Column) -> DataFrame:
    """The register with what is published now: slug, id, name, location, start_local, lat, lng, first_seen, last_seen.

    A known slug keeps first_seen and takes what the published row has; a new one begins now. Slugs that aren't published stay as they are.
    """
    fields = ["id", "name", "location", "start_local", "lat", "lng"]
    now = published.select("slug", *(F.col(f).alias(f"_{f}") for f in fields)).withColumn("_seen", at)
    rows = register.join(now, "slug", "full")
    return rows.select("slug", *(F.coalesce(f"_{f}", f).alias(f) for f in fields), F.coalesce("first_seen", "_seen").alias("first_seen"), F.coalesce("_seen", "last_seen").alias("last_seen"))


def _venue(location: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.split(F.coalesce(location, F.lit("")), ",")[0])), F.lit(""))


def rare_first(names: DataFrame) -> DataFrame:
    """name, title: the distinct content words of each distinct name, those first that the fewest names have."""
    words = names.distinct().select("name", F.explode(content_words(normalize_name(F.col("name")))).alias("word"))
    held = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word")
    return held.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("title"))


def telling_head(title: Column, least: float) -> Column:
    """The words of a title, rarest first, of which two titles share one if their words are at least so much alike (Jaccard)."""
    return F.slice(title, 1, F.size(title) - F.ceil(F.size(title) * least).cast("int") + 1)


def alike_titles(register: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """r_name, n_name, x: distinct names of both tables whose words are at least so much alike. They meet by one of their rarest words, each two by the first that they share."""
    c = F.col
    titles = kept(rare_first(register.select("name").union(live.select("name"))))
    heads = titles.withColumn("head", telling_head(c("title"), least))
    side = lambda of, mark: heads.join(of.select("name").distinct(), "name").select(*(c(x).alias(f"{mark}_{x}") for x in ("name", "title", "head")), F.explode("head").alias("word"))
    both = F.size(F.array_intersect("r_title", "n_title"))
    alike = both / (F.size("r_title") + F.size("n_title") - both)
    met = side(register, "r").join(side(live, "n"), "word").filter(c("word") == F.element_at(F.array_intersect("r_head", "n_head"), 1))
    return met.select("r_name", "n_name", alike.alias("x")).filter(c("x") >= least)


def near_addresses(register: DataFrame, live: DataFrame, km: float) -> DataFrame:
    """r_at, n_at: distinct places (at: lat, lng, venue) of both tables that are one place: near by coordinates where both have them, else the one's venue holds the other's.

    Places meet by cells of a grid, beyond 60 degrees by its rows alone, and by the first three letters of a venue that the other's holds.
    """
    c, none = F.col, F.array().cast("array<string>")
    lat, lng, venue = c("at.lat"), c("at.lng"), c("at.venue")
    row, col = F.floor(lat * 111.0 / km), F.floor(lng * 111.0 / km / 2.1)
    known = lat.isNotNull() & lng.isNotNull()
    cells = lambda around: F.when(known & (F.abs(lat) <= 60), F.array(*(F.concat_ws("|", F.lit("c"), row + i, col + j) for i in around for j in around)))
    rows = lambda around: F.when(known & (F.abs(lat) > 59), F.array(*(F.concat_ws("|", F.lit("r"), row + i) for i in around)))
    grid = lambda around: F.concat(F.coalesce(cells(around), none), F.coalesce(rows(around), none))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(venue) - 2, F.lit(1))), lambda i: venue.substr(i, F.lit(3)))
    holds = F.coalesce(F.when(venue.isNotNull(), F.array_distinct(F.concat(grams, F.array(F.lit(""))))), none)
    head = F.array_compact(F.array(F.when(F.length(venue) > 2, F.substring(venue, 1, 3)).otherwise(F.when(venue.isNotNull(), ""))))
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    side = lambda of, mark, keys: of.select(F.struct("lat", "lng", "venue").alias("at")).distinct().select(c("at").alias(f"{mark}_at"), F.explode(keys).alias("k"))
    r = side(register, "r", F.concat(grid((-1, 0, 1)), tagged("h", head), tagged("i", holds)))
    n = side(live, "n", F.concat(grid((0,)), tagged("h", holds), tagged("i", head)))
    dlat, dlng = (c("r_at.lat") - c("n_at.lat")) * 111.0, (c("r_at.lng") - c("n_at.lng")) * 111.0 * F.cos(F.radians((c("r_at.lat") + c("n_at.lat")) / 2))
    text = F.contains("r_at.venue", "n_at.venue") | F.contains("n_at.venue", "r_at.venue")
    return r.join(n, "k").filter(F.coalesce(F.sqrt(dlat * dlat + dlng * dlng) <= km, text, F.lit(False))).select("r_at", "n_at").distinct()


def _place(of: Column) -> Column:
    """A number for a place (lat, lng, venue); nulls are equal here."""
    parts = [of[x] for x in ("lat", "lng", "venue")]
    return F.xxhash64(*parts, *(x.isNull() for x in parts))


def _titled(rows: DataFrame) -> DataFrame:
    """What titles are compared by: slug, name, start_local, lat, lng, venue, and own where it is there."""
    c = F.col
    own = [x for x in ("own",) if x in rows.columns]
    return rows.select("slug", *own, "name", "start_local", (c("lat") + 0.0).alias("lat"), (c("lng") + 0.0).alias("lng"), _venue(c("location")).alias("venue"))


_CLASS = ["r_name", "r_place", "r_start", "own"]


def _asking(rows: DataFrame) -> DataFrame:
    """rows of _titled with the columns of _CLASS: rows alike in these have one answer."""
    c = F.col
    return rows.select("slug", "own", c("name").alias("r_name"), _place(F.struct("lat", "lng", "venue")).alias("r_place"), c("start_local").alias("r_start"))


def _best_titles(r: DataFrame, n: DataFrame, least: float, km: float, days: int) -> DataFrame:
    """The columns of _CLASS and target: what rows of r (of _titled) so named, at such a place and start are answered by, of the rows of n."""
    c = F.col
    titles = alike_titles(r, n, least).select("r_name", "n_name", "x")
    places = near_addresses(r, n, km).select(_place(c("r_at")).alias("r_place"), _place(c("n_at")).alias("n_place"))
    asked = _asking(r).filter("r_start is not null").select(*_CLASS).distinct()
    at = _place(F.struct("lat", "lng", "venue"))
    there = n.filter("start_local is not null").groupBy(c("name").alias("n_name"), at.alias("n_place"), c("start_local").alias("n_start"), c("own").alias("n_own")).agg(F.count("*").alias("n"), F.min("slug").alias("target"))
    seen = lambda *own: there.join(titles, "n_name").join(places, "n_place").groupBy("r_name", "r_place", "x", "n_start", *own).agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    swept = best_within(asked.filter("own is null"), seen(), days).withColumn("own", F.lit(None).cast("string")).select(*_CLASS, "target")
    on = F.explode(F.array(*(F.date_add(F.to_date("r_start"), i) for i in range(-days, days + 1))))
    met = asked.filter("own is not null").withColumn("day", on).join(seen("n_own").withColumn("day", F.to_date("n_start")), ["r_name", "r_place", "day"])
    met = met.filter((F.abs(seconds_between(c("r_start"), c("n_start"))) <= days * 86400) & ~F.coalesce(c("own") == c("n_own"), F.lit(False)))
    best = met.groupBy(*_CLASS, "x").agg(F.sum("n").alias("n"), F.min("target").alias("target")).groupBy(*_CLASS).agg(F.max(F.struct("x", "n", "target")).alias("m"))
    return swept.union(best.filter("m.n = 1").select(*_CLASS, c("m.target").alias("target")))


def best_within(asked: DataFrame, seen: DataFrame, days: int) -> DataFrame:
    """r_name, r_place, r_start, target: of each row of asked the one of seen (x, n_start, n, target; n rows that one stands for) with its r_name and r_place, so many days (one or more)
    before or after it, whose x is largest; none where that x is there twice.

    A row of asked stands in the order of each of its days. The first day's is met from it on, the last day's up to it, those between whole: what is best so far is passed on from
    either end, so rows don't meet one by one and a crowded day costs no more than its rows.
    """
    if days < 1:
        raise ValueError("days must be one or more")
    c, by = F.col, ["r_name", "r_place", "day"]
    one = lambda x: F.struct(x.alias("x"), c("n_start").alias("at"), "n", "target")
    points = seen.select("r_name", "r_place", F.to_date("n_start").alias("day"), c("n_start").alias("at"), one(c("x")).alias("last"), one(-c("x")).alias("first"))
    on = asked.select("r_name", "r_place", "r_start", F.explode(F.array(*map(F.lit, range(-days, days + 1)))).alias("i"))
    asks = on.select("r_name", "r_place", F.date_add(F.to_date("r_start"), c("i")).alias("day"), F.timestamp_add("DAY", c("i"), c("r_start")).cast("timestamp_ntz").alias("at"), "r_start", "i")
    up, down = W.partitionBy(*by).orderBy("at"), W.partitionBy(*by).orderBy(F.desc("at"))
    best = lambda w, way: [F.max("last").over(w).alias(f"last_{way}"), F.min("first").over(w).alias(f"first_{way}")]
    met = points.unionByName(asks, allowMissingColumns=True).select("*", *best(up, "up"), *best(down, "down")).filter("i is not null")
    ends = lambda of: [F.when(c("i") > -days, c(f"{of}_up")), F.when(c("i") < days, c(f"{of}_down"))]
    found = met.groupBy("r_name", "r_place", "r_start").agg(F.max(F.greatest(*ends("last"))).alias("last"), F.min(F.least(*ends("first"))).alias("first"))
    return found.filter("last.at = first.at and last.n = 1").select("r_name", "r_place", "r_start", c("last.target").alias("target"))


def _answered(asked: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """asked (with the columns of _CLASS) and target."""
    c = F.col
    one = answers.select(*(c(k).alias(f"m_{k}") for k in _CLASS), c("target"))
    same = (c("r_name") == c("m_r_name")) & (c("r_place") == c("m_r_place")) & (c("r_start") == c("m_r_start")) & c("own").eqNullSafe(c("m_own"))
    return asked.join(one, same, how).drop(*(f"m_{k}" for k in _CLASS))


def retitled(register: DataFrame, live: DataFrame, least: float = 0.5, km: float = 0.2, days: int = 2) -> DataFrame:
    """slug, target: the live row (by its slug) at the place, within the days, whose title is most alike (Jaccard of words, so much at least);
    two equally alike give none.

    One place: near by coordinates where both have them, else the first part of one address holds the other's. Which titles and which places are alike is worked out once for each two
    of them. Rows alike in title, place and start have one answer, so they are one row, on either side, with how many live rows it stands for and the smallest of their slugs; only
    a slug that both tables have, whose own row is no answer, stays by itself and meets the live rows near it one by one; all others are found by best_within.
    """
    live = kept(live.select("slug", "name", "location", "start_local", "lat", "lng"))  # slugs are worked out once
    shared = kept(register.select("slug").intersect(live.select("slug")).withColumn("own", F.col("slug")))
    r, n = (kept(_titled(t.join(shared, "slug", "left"))) for t in (register, live))
    return _answered(_asking(r), _best_titles(r, n, least, km, days), "inner").select("slug", "target")


def resolve(register: DataFrame, published: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """slug, status, target, reason of the register's addresses: live; alias of the live slug of the row's id (renamed), of its group (same: node,
    group; merged), of the first with its name and venue (rescraped), or of its title (retitled); else ended.

    Names are made normal once for each two of name and location, and what is told without titles is kept: only addresses that have no answer are asked for by title.
    """
    c, none = F.col, F.lit(None).cast("string")
    live = kept(published.select("slug", "id", "ord", "name", "location", "start_local", "lat", "lng"))  # read for each kind of alias
    first = F.min_by("slug", "ord").alias("first"), F.min("ord").alias("ord")
    again = lambda of: F.min_by("first", "ord").alias(of)  # the first of firsts
    named = lambda of: of.withColumn("norm", normalize_name(c("name"))).withColumn("venue", F.coalesce(_venue(c("location")), F.lit("")))
    by_id = live.groupBy("id").agg(*first)
    # Both are kept, so that no test of a normal name is moved below the grouping, to every row.
    by_name = named(kept(live.groupBy("name", "location").agg(*first))).groupBy("norm", "venue").agg(again("rescraped")).filter("norm <> ''")
    by_name = named(kept(register.select("name", "location").distinct())).join(by_name, ["norm", "venue"]).select(c("name").alias("_name"), c("location").alias("_location"), "rescraped")
    if same is None:
        told = by_id.select("id", c("first").alias("renamed"), none.alias("merged"))
    else:
        member = same.select(c("node").alias("id"), "group")
        merged = member.join(by_id.join(member, "id").groupBy("group").agg(again("merged")), "group").select("id", "merged")
        told = by_id.select("id", c("first").alias("renamed")).join(merged, "id", "full")
    rows = register.join(told, "id", "left").join(by_name, (c("name") == c("_name")) & c("location").eqNullSafe(c("_location")), "left").join(live.select("slug", F.lit(True).alias("is_live")).distinct(), "slug", "left")
    kinds = ["renamed", "merged", "rescraped"]
    gone, found = c("is_live").isNull(), F.coalesce(*kinds)
    reason = F.coalesce(*(F.when(c(k).isNotNull(), F.lit(k)) for k in kinds))
    fate = F.when(~gone, "live").when(found.isNotNull(), "alias")
    facts = [F.when(fate.isNull(), c(x)).alias(x) for x in ("name", "location", "start_local", "lat", "lng")]
    rows = kept(rows.select("slug", fate.alias("status"), F.when(gone, found).alias("target"), F.when(gone, reason).alias("reason"), *facts))
    left, there = (_titled(t.withColumn("own", none)) for t in (rows.filter("status is null"), live))
    by_title = _answered(_asking(left), _best_titles(left, there, 0.5, 0.2, 2), "left")
    alias = c("target").isNotNull()
    by_title = by_title.select("slug", F.when(alias, "alias").otherwise("ended").alias("status"), "target", F.when(alias, "retitled").alias("reason"))
    return rows.filter("status is not null").select("slug", "status", "target", "reason").union(by_title)


def flatten_chains(links: DataFrame, live: DataFrame | None = None, hops: int = 10) -> DataFrame:
    """slug, target of aliases (slug, target): each followed for up to so many further hops. With live (slug): a target that isn't live is null.

    Hops are joined in powers of two: 10 are 8 and 2.
    """
    step = links.select(F.col("slug").alias("at"), F.col("target").alias("to"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.join(second.select(F.col("at").alias("to"), F.col("to").alias("further")), "to", "left").select("at", F.coalesce("further", "to").alias("to"))

    out = step
    while hops:
        if hops % 2:
            out = then(out, step)
        hops //= 2
        if hops:
            step = then(step, step)
    out = out.select(F.col("at").alias("slug"), F.col("to").alias("target"))
    if live is None:
        return out
    return out.join(live.select(F.col("slug").alias("target"), F.lit(True).alias("is_live")).distinct(), "target", "left").select("slug", F.when(F.col("is_live"), F.col("target")).alias("target"))
