"""Grades of pairs of listings, found by classes of names and places.

Names and places repeat, so what two names or two places have to do with each other is worked out once for each two of them, in small tables. Listings then
meet by keys of what a rule needs: a related name and a near day, a same place and day, a related name at a same place. Each pair comes from the first
of these that it fits, so none has to be taken out again, and what meets is close to what gets a grade.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import shared_word_count
from ..functions.places import SAME_PLACE_KM, distance_km
from .stage import kept

#: A cell of the grid that finds near places, in degrees: its neighbours cover SAME_PLACE_KM up to latitude NORTH.
CELL, NORTH = 0.005, 56.9
DAY = 86_400_000_000
_NAME, _PLACE = ["norm", "words", "telling", "styles_named", "days_named"], ["place", "canon", "lat", "lng"]
c = F.col


def micros(t: Column) -> Column:
    """A wall clock as microseconds."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


def least_gap(xs: Column, ys: Column) -> Column:
    """The least distance of an element of one array to one of the other, null where one is empty: the nearest two are neighbours in the order of both, so
    one walk over them finds it."""
    tagged = lambda a, side: F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("long").alias("t"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("long").alias("best"))
    step = lambda at, e: F.struct(e["t"].alias("t"), e["side"].alias("side"), F.when(at["side"] != e["side"], F.least(at["best"], e["t"] - at["t"])).otherwise(at["best"]).alias("best"))
    return F.aggregate(F.array_sort(F.concat(tagged(xs, 0), tagged(ys, 1))), start, step, lambda at: at["best"])


def _numbered(rows: DataFrame, columns: list[str], number: str) -> tuple[DataFrame, DataFrame]:
    """The distinct values of columns with a number each, and rows with it."""
    key = F.to_json(F.struct(*columns)).alias("class_key")
    classes = kept(rows.select(*columns, key).dropDuplicates(["class_key"]).withColumn(number, F.monotonically_increasing_id()))
    return classes, rows.withColumn("class_key", key).join(classes.select("class_key", number), "class_key").drop("class_key")


def related_names(names: DataFrame) -> DataFrame:
    """p, q and what holds of their names: exact, inside, strong, strong_back (q's words first), other_styles, other_days. p is the longer name, so that a row of
    it meets the few names that it holds and not all that hold it; every name is related to itself.

    Names meet by a telling word, by all of the name, or where one begins what the other holds (three letters).
    """
    some = names.filter("norm <> ''")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm") - 2, F.lit(1))), lambda i: c("norm").substr(i, F.lit(3))))
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    equal = F.concat(tagged("w", c("telling")), F.array(F.concat(F.lit("n"), "norm")))
    head = F.when(F.length("norm") > 2, F.concat(F.lit("i"), F.substring("norm", 1, 3))).otherwise("i")
    longer = some.select(c("nid").alias("p"), F.explode(F.concat(equal, tagged("i", F.concat(grams, F.array(F.lit("")))))).alias("k"))
    shorter = some.select(c("nid").alias("q"), F.explode(F.concat(equal, F.array(head))).alias("k"))
    size = lambda side: some.select(c("nid").alias(side), F.struct(F.length("norm"), "nid").alias(f"{side}_size"), F.struct(*_NAME).alias(f"{side}n"))
    met = longer.join(shorter, "k").select("p", "q").distinct().join(size("p"), "p").join(size("q"), "q").filter("p_size >= q_size")
    x, y = (lambda n: c(f"pn.{n}")), (lambda n: c(f"qn.{n}"))
    enough = F.greatest(F.lit(2.0), F.least(F.size(x("words")), F.size(y("words"))) * 0.5)
    telling = F.arrays_overlap(x("telling"), y("telling"))
    strong = lambda a, b: F.coalesce((shared_word_count(a, b) >= enough) & telling, F.lit(False))
    without = lambda a, b: F.size(F.array_except(a, b)) > 0
    styles = without(x("styles_named"), y("styles_named")) & without(y("styles_named"), x("styles_named")) & (F.size(x("styles_named")) > 0) & (F.size(y("styles_named")) > 0)
    days = (F.size(x("days_named")) > 0) & (F.size(y("days_named")) > 0) & ~F.arrays_overlap(x("days_named"), y("days_named"))
    facts = met.select("p", "q", (x("norm") == y("norm")).alias("exact"), F.contains(x("norm"), y("norm")).alias("inside"), strong(x("words"), y("words")).alias("strong"), strong(y("words"), x("words")).alias("strong_back"), styles.alias("other_styles"), F.coalesce(days, F.lit(False)).alias("other_days"))
    return facts.filter("exact or inside or strong or strong_back")


def same_places(places: DataFrame) -> DataFrame:
    """p, q (both ways, and each with itself), same, same_back: one place as seen from p, and from q. By canonical names where both have one, else near by
    coordinates or equal by text. Cells get too narrow in the far north, where the row of the grid alone is a key."""
    row, col, none = F.floor(c("lat") / CELL), F.floor(c("lng") / CELL), F.array().cast("array<string>")
    north = F.abs(c("lat")) > NORTH
    near = lambda around: F.when(north, F.array(*(F.concat_ws("|", F.lit("r"), row + i) for i in around))).when(row.isNotNull() & col.isNotNull(), F.array(*(F.concat_ws("|", F.lit("g"), row + i, col + j) for i in around for j in around)))
    keys = lambda around: F.array_distinct(F.concat(F.coalesce(near(around), none), F.array_compact(F.array(F.concat(F.lit("t"), "place"), F.concat(F.lit("c"), "canon")))))
    side = lambda mark, around: places.select(c("pid").alias(mark), F.struct(*_PLACE).alias(f"{mark}p"), F.explode(keys(around)).alias("k"))
    x, y = (lambda n: c(f"pp.{n}")), (lambda n: c(f"qp.{n}"))
    close = lambda a, b: F.coalesce(distance_km(a("lat"), a("lng"), b("lat"), b("lng")) <= SAME_PLACE_KM, F.lit(False)) | F.coalesce(a("place") == b("place"), F.lit(False))
    same = lambda a, b: F.when(a("canon").isNotNull() & b("canon").isNotNull(), a("canon") == b("canon")).otherwise(close(a, b))
    met = side("p", (-1, 0, 1)).join(side("q", (0,)), "k").select("p", "q", same(x, y).alias("same"), same(y, x).alias("same_back")).filter("same or same_back")
    return met.distinct()


def graded_pairs(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """a, b, ao, bo, grade of all pairs of prepared rows that have a grade, a before b in ord; with others, of a row and another table's row, no others.

    The first that fits, between rows that are both or neither a venue record: one id, or one address and nights (starts; column all_nights has them all) within a day or unknown (certain);
    related names within a day (certain at one place; else review); one name and an unknown start (review); one place and day
    (review); related names at one place within a week (review), or that recur on one weekday (certain, but review for other styles or clocks).
    """
    columns = ["id", "ord", "hub", "key", "start_local", "recurring", *_NAME, *_PLACE]
    dated = any("all_nights" in side.columns for side in (rows, others) if side is not None)
    nights = lambda side: [(c("all_nights") if "all_nights" in side.columns else F.lit(None).cast("array<timestamp_ntz>")).alias("all_nights")] if dated else []
    every = rows.select(*columns, *nights(rows), F.lit(True).alias("mine"))
    if others is not None:
        every = every.union(others.select(*columns, *nights(others), F.lit(False)))
    names, every = _numbered(every, _NAME, "nid")
    places, every = _numbered(every, _PLACE, "pid")
    all_nights = [F.transform("all_nights", micros).alias("ts")] if dated else []
    every = kept(every.select("id", "ord", "hub", "mine", "nid", "pid", "recurring", F.coalesce("norm", F.lit("")).alias("norm"), F.coalesce("key", F.lit("")).alias("url"), micros(c("start_local")).alias("t"), *all_nights))
    related, same = kept(related_names(names)), kept(same_places(places))
    day, week = F.floor(c("t") / DAY), F.floor(c("t") / (7 * DAY))
    dow = F.pmod(day, F.lit(7))
    around = lambda x: F.array(x - 1, x, x + 1)
    facts = ["id", "ord", "mine", "nid", "pid", "recurring", "url", "t", *(["ts"] if dated else [])]

    def own(key: Column, rows: DataFrame = every) -> DataFrame:
        return rows.select(F.struct(*facts).alias("y"), key.alias("k")).filter("k is not null")

    def meet(x: DataFrame, y: DataFrame, *extra: str) -> DataFrame:
        """x (struct x, key k) with y (struct y, key k): rows of both tables, where there are two."""
        met = x.join(y, "k").select("x", "y", *extra)
        return met if others is None else met.filter("x.mine <> y.mine")

    def asking(rows: DataFrame, key: Column, *extra: str) -> DataFrame:
        return rows.select(F.struct(*facts).alias("x"), *extra, key.alias("k")).filter("k is not null")

    key = lambda *parts: F.xxhash64("hub", *parts)
    gap = F.abs(c("x.t") - c("y.t"))
    near = gap < DAY
    forward = c("x.ord") < c("y.ord")
    one_night = near
    if dated:
        of = lambda side: F.coalesce(c(f"{side}.ts"), F.array_compact(F.array(c(f"{side}.t"))))
        one_night = F.when(c("x.ts").isNull() & c("y.ts").isNull(), near).otherwise(least_gap(of("x"), of("y")) < DAY)
    same_url = (c("x.url") == c("y.url")) & (c("x.url") != "")
    one_id, one_url = c("x.id") == c("y.id"), F.when(same_url, F.coalesce(one_night, F.lit(True))).otherwise(F.lit(False))
    told = F.coalesce(one_id | one_url, F.lit(False))
    apart = ~told if dated else ~one_id  # starts a day or more apart rule one address out, other nights don't
    once = (c("x.nid") != c("y.nid")) | forward  # a name's rows meet each other both ways
    flags = ["exact", "inside", "strong", "strong_back", "other_styles", "other_days"]
    with_names = every.join(related.withColumnRenamed("p", "nid"), "nid")
    strong = F.when(forward, c("strong")).otherwise(c("strong_back"))
    out = []

    def found(met: DataFrame, grade: Column | str) -> None:
        pick = lambda n, way: F.when(forward == F.lit(way), c(f"x.{n}")).otherwise(c(f"y.{n}"))
        out.append(met.select(pick("id", True).alias("a"), pick("id", False).alias("b"), pick("ord", True).alias("ao"), pick("ord", False).alias("bo"), (F.lit(grade) if isinstance(grade, str) else grade).alias("grade")))

    found(meet(asking(every, key("id")), own(key("id"))).filter(forward if others is None else c("x.mine")).filter(one_id), "certain")
    # rows of one address meet by its nights, those without any by the address alone
    addressed = every.filter("url <> ''")
    at_night = addressed.withColumn("o", F.explode(F.coalesce("ts", F.array("t")))) if dated else addressed.withColumn("o", c("t"))
    at_night, night = at_night.filter("o is not null"), F.floor(c("o") / DAY)
    asked = at_night.select(F.struct(*facts).alias("x"), c("o").alias("xo"), "hub", "url", F.explode(around(night)).alias("d")).select("x", "xo", key("url", "d").alias("k"))
    answering = at_night.select(F.struct(*facts).alias("y"), c("o").alias("yo"), key("url", night).alias("k"))
    found(meet(asked, answering, "xo", "yo").filter(forward if others is None else c("x.mine")).filter(same_url & ~one_id & (F.abs(c("xo") - c("yo")) < DAY)), "certain")
    if dated:  # two series may share many nights
        out[-1] = out[-1].distinct()
    none_known = lambda side: c(f"{side}t").isNull() & (c(f"{side}ts").isNull() if dated else F.lit(True))
    dateless = meet(asking(addressed.filter(none_known("")), key("url")), own(key("url"), addressed))
    found(dateless.filter(same_url & ~one_id & (~none_known("y.") | (forward if others is None else c("x.mine")))), "certain")

    clock = F.abs(F.floor(c("x.t") / 60_000_000) % 1440 - F.floor(c("y.t") / 60_000_000) % 1440)
    clock = F.least(clock, 1440 - clock)
    both = c("x.recurring") & c("y.recurring")
    weekly = both & (F.pmod(F.floor(c("x.t") / DAY) - F.floor(c("y.t") / DAY), F.lit(7)) == 0)
    series = F.when(c("other_styles") | (clock > 120), "review").otherwise("certain")
    there = F.coalesce(F.when(forward, c("same")).otherwise(c("same_back")), F.lit(False))
    one_day = F.floor(c("x.t") / DAY) == F.floor(c("y.t") / DAY)

    days = F.explode(around(day))
    close = meet(asking(with_names, key("q", day), *flags), every.select(F.struct(*facts).alias("y"), "hub", "nid", days.alias("d")).select("y", key("nid", "d").alias("k")), *flags)
    close = close.filter(once & near & ~told & (c("exact") | c("inside") | strong))
    close = close.withColumn("p", c("x.pid")).withColumn("q", c("y.pid")).join(same, ["p", "q"], "left")
    found(close, F.when(there & one_day, "certain").when(c("exact") & there, "certain").when(there & (c("exact") | strong) & weekly, series).otherwise("review"))

    unknown = meet(asking(with_names.filter("exact and t is null"), key("q")), own(key("nid"), every.filter("t is null"))).filter(once & ~told)
    found(unknown, "review")
    both_ways = related.filter("exact").select("p", "q").union(related.filter("exact and p <> q").select(c("q").alias("p"), c("p").alias("q"))).withColumnRenamed("p", "nid")
    half = meet(asking(every.filter("t is null").join(both_ways, "nid"), key("q")), own(key("nid"), every.filter("t is not null"))).filter(~told)
    found(half, "review")

    at_places = every.filter("norm <> ''").join(same.select(c("p").alias("pid"), c("q").alias("at"), "same", "same_back"), "pid")
    placed = meet(asking(at_places, key("at", day), "same", "same_back"), own(key("pid", day), every.filter("norm <> '' and t is not null")), "same", "same_back").filter(forward if others is None else c("x.mine"))
    placed = placed.filter(there & one_day & ~told).withColumn("lo", F.least("x.nid", "y.nid")).withColumn("hi", F.greatest("x.nid", "y.nid"))
    alike = related.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), c("p").alias("longer"), *flags)
    placed = placed.join(alike, ["lo", "hi"], "left")
    way = F.when(F.when(forward, c("x.nid")).otherwise(c("y.nid")) == c("longer"), c("strong")).otherwise(c("strong_back"))
    found(placed.filter(~F.coalesce(c("exact") | c("inside") | way, F.lit(False))), "review")

    named_at = with_names.join(same.select(c("p").alias("pid"), c("q").alias("at"), "same", "same_back"), "pid")
    more = (*flags, "same", "same_back")
    weeks = every.select(F.struct(*facts).alias("y"), "hub", "nid", "pid", F.explode(around(week)).alias("w")).select("y", key("nid", "pid", "w").alias("k"))
    in_week = meet(asking(named_at, key("q", "at", week), *more), weeks, *more).filter(once & there & (gap >= DAY) & (gap < 7 * DAY) & apart & (c("exact") | c("inside") | strong))
    found(in_week, F.when((c("exact") | strong) & weekly, series).when(~(both & c("other_days")), "review"))
    again = F.when(c("recurring"), key("q", "at", dow))
    later = meet(asking(named_at, again, *more), own(F.when(c("recurring"), key("nid", "pid", dow))), *more).filter(once & there & weekly & (gap >= 7 * DAY) & apart & (c("exact") | strong))
    found(later, series)
    return reduce(DataFrame.unionByName, out).filter("grade is not null")
