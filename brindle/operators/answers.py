"""Reviewers' answers: each fans out to changes of several tables, which are then folded into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.places import place_text
from .lifecycle import block_key
from .match import latest, special_mismatch

#: Letters of the shortest note that explains something.
LEAST_NOTE = 10
#: What answers do: kind of question, choice, what it needs, then changes (table, action, whose: the subject or the other listing, value). A value that begins with
#: = names a fact of the question. Tables: pools (to a pool, or merged into the other), holds, verdicts, blocks, rulings, excluded days, edits, dismissals.
_BLOCKS = [(kind, category, "", [("pools", "gone", "subject", ""), ("blocks", "block", "subject", category)]) for kind in ("new", "possible_duplicate", "rejected") for category in ("off_topic", "elsewhere", "duplicate_source")]
RULES: list[tuple[str, str, str, list[tuple[str, str, str, str]]]] = [
    ("new", "approve", "place", [("pools", "to", "subject", "active")]),
    ("new", "already_listed", "other", [("pools", "merged", "subject", "=other"), ("verdicts", "same", "subject", "=other")]),
    ("new", "no_link_yet", "", [("pools", "to", "subject", "rejected")]),
    ("possible_duplicate", "same", "other not_special", [("pools", "merged", "subject", "=other"), ("verdicts", "same", "subject", "=other")]),
    ("possible_duplicate", "different", "other place", [("pools", "to", "subject", "active"), ("verdicts", "different", "subject", "=other")]),
    ("possible_duplicate", "no_link_yet", "", [("pools", "to", "subject", "rejected")]),
    ("active_duplicate", "same", "other not_special", [("pools", "merged", "later", "=earlier"), ("verdicts", "same", "subject", "=other")]),
    ("active_duplicate", "different", "other", [("verdicts", "different", "subject", "=other")]),
    ("rejected", "restore", "", [("pools", "to", "subject", "active")]),
    ("venue_conflict", "distinct", "", [("rulings", "distinct", "subject", "")]),
    ("venue_conflict", "replaces", "", [("rulings", "replaces", "subject", ""), ("excluded", "exclude", "other", "=day")]),
    ("venue_conflict", "duplicate", "other", [("rulings", "duplicate", "subject", ""), ("pools", "to", "subject", "archive")]),
    ("signal", "not_an_event", "", [("dismissals", "dismiss", "subject", "=day")]),
    ("date", "use_source_date", "source_day", [("edits", "start_day", "subject", "=source_day")]),
    ("date", "not_happening", "", [("pools", "to", "subject", "archive"), ("holds", "hold", "subject", "cancelled")]),
    ("date", "keep", "note", [("edits", "manual_check", "subject", "=note")]),
    ("location", "use_source_place", "source_place", [("edits", "location", "subject", "=source_place")]),
    ("location", "keep", "note", [("edits", "manual_check", "subject", "=note")]),
    ("no_link", "archive", "", [("pools", "to", "subject", "archive"), ("holds", "hold", "subject", "no_link")]),
    ("broken_link", "drop_link", "", [("edits", "removed_url", "subject", "=url")]),
    ("cancelled", "confirm", "", [("pools", "to", "subject", "archive"), ("holds", "hold", "subject", "cancelled")]),
    ("cancelled", "keep", "note", [("edits", "manual_check", "subject", "=note")]),
    *_BLOCKS,
]


def effects(spark) -> DataFrame:
    """kind, choice, needs, tbl, action, whose, value: RULES as a table, a row for each change."""
    return spark.createDataFrame([(kind, choice, needs, *change) for kind, choice, needs, changes in RULES for change in changes], "kind string, choice string, needs string, tbl string, action string, whose string, value string")


def apply_answers(worklist: DataFrame, answers: DataFrame, listings: DataFrame) -> DataFrame:
    """The log of changes: item, kind, choice, refused, tbl, action, id, value, seq.

    worklist: item, kind, subject, other (null: none), source_day, source_place. answers: item, seq, choice, note; of an item the last valid one counts, ties by
    choice. An answer is valid if RULES has its choice for the item's kind. A refused one (its reason in refused) changes nothing, so its item
    stays open; so does one without a valid answer, which isn't in the log. Refused: the subject is gone; what the rule needs is missing (other:
    the other listing; place, source_day, source_place: their values; note: one of LEAST_NOTE letters); two are to be one, of which one is a special edition (not_special).
    """
    c = F.col
    rules = effects(listings.sparkSession)
    valid = answers.join(worklist.select("item", "kind"), "item").join(rules.select("kind", "choice").distinct(), ["kind", "choice"], "left_semi")
    chosen = valid.groupBy("item").agg(F.max(F.struct("seq", "choice", "note")).alias("a")).select("item", "a.seq", "a.choice", "a.note")
    facts = lambda mark: listings.select(c("id").alias(mark), F.struct("ord", normalize_name(c("name")).alias("norm"), "location", "url", F.to_date("start_local").cast("string").alias("day")).alias(f"{mark}_row"))
    rows = worklist.join(chosen, "item").join(facts("subject"), "subject", "left").join(facts("other"), "other", "left")
    no = F.lit(False)
    first = F.coalesce(c("subject_row.ord") < c("other_row.ord"), F.lit(True))
    values = {
        "other": c("other"), "earlier": F.when(first, c("subject")).otherwise(c("other")), "day": c("subject_row.day"), "source_day": c("source_day").cast("string"), "source_place": c("source_place"), "note": F.trim("note"), "url": c("subject_row.url"),
    }
    needs = lambda what: F.array_contains(F.split("needs", " "), what)
    refused = (
        F.when(c("subject_row").isNull(), "gone").when(needs("other") & c("other_row").isNull(), "no other listing").when(needs("place") & F.coalesce(F.trim(c("subject_row.location")) == "", F.lit(True)), "no place")
        .when(needs("source_day") & c("source_day").isNull(), "no date to use").when(needs("source_place") & (F.coalesce("source_place", F.lit("")) == ""), "no place to use").when(needs("note") & (F.length(F.trim(F.coalesce("note", F.lit("")))) < LEAST_NOTE), "no note")
        .when(needs("not_special") & F.coalesce(special_mismatch(c("subject_row.norm"), c("other_row.norm")), no), "special edition")
    )
    log = rows.join(rules, ["kind", "choice"]).withColumn("refused", refused)
    whose = F.when(c("whose") == "other", c("other")).when(c("whose") == "later", F.when(first, c("other")).otherwise(c("subject"))).otherwise(c("subject"))
    value = c("value")
    for name, fact in values.items():
        value = F.when(c("value") == f"={name}", fact).otherwise(value)
    of = lambda x: F.when(c("refused").isNull(), x)
    # A refused answer is one row, without a change.
    return log.select("item", "kind", "choice", "refused", of(c("tbl")).alias("tbl"), of(c("action")).alias("action"), of(whose).alias("id"), of(value).alias("value"), "seq").distinct()


def changes(log: DataFrame, tbl: str) -> DataFrame:
    """The last change of each row of a table; ties by item."""
    return latest(log.filter(F.col("tbl") == tbl), ["id"], ["seq", "item"])


def pools_after(listings: DataFrame, log: DataFrame) -> DataFrame:
    """id, pool, hold, merged_into after the log. A row that is blocked or merged is in no pool (null). Merges follow to the last row that stays: answers that merge
    in a circle change nothing."""
    c = F.col
    moved = changes(log, "pools").select("id", "action", "value")
    hops = moved.filter("action = 'merged'").select("id", c("value").alias("into"))
    for _ in range(5):  # up to 32 merges in a row
        further = hops.select(c("id").alias("into"), c("into").alias("next"))
        hops = hops.join(further, "into", "left").select("id", F.coalesce("next", "into").alias("into"))
    ended = hops.join(moved.filter("action = 'merged'").select(c("id").alias("into")), "into", "left_anti")
    held = changes(log, "holds").select("id", c("value").alias("hold"))
    rows = listings.select("id", "pool").join(moved, "id", "left").join(ended, "id", "left").join(held, "id", "left")
    pool = F.when(c("action") == "to", c("value")).when((c("action") == "gone") | c("into").isNotNull(), F.lit(None).cast("string")).otherwise(c("pool"))
    return rows.select("id", pool.alias("pool"), F.when(pool == "archive", c("hold")).alias("hold"), c("into").alias("merged_into"))


def verdicts_after(verdicts: DataFrame, log: DataFrame) -> DataFrame:
    """a, b (a before b), verdict: those recorded before and the log's, which replace theirs."""
    fresh = latest(log.filter("tbl = 'verdicts'").select(F.least("id", "value").alias("a"), F.greatest("id", "value").alias("b"), F.col("action").alias("verdict"), "seq", "item"), ["a", "b"], ["seq", "item"])
    return verdicts.select("a", "b", "verdict").join(fresh, ["a", "b"], "left_anti").unionByName(fresh.select("a", "b", "verdict"))


def blocks_after(blocked: DataFrame, listings: DataFrame, log: DataFrame) -> DataFrame:
    """id, source, key, category: blocks kept as they are, and the log's with the key that the listing has now."""
    new = changes(log, "blocks").join(blocked.select("id"), "id", "left_anti").join(listings, "id")
    key = block_key(normalize_name(F.col("name")), place_text(F.col("location")))
    return blocked.select("id", "source", "key", "category").unionByName(new.select("id", "source", key.alias("key"), F.col("value").alias("category")))


def edits_after(listings: DataFrame, log: DataFrame) -> DataFrame:
    """id, start_local, end_local, location, url, dropped (addresses not to come back), manual_check of rows with edits: a moved day keeps clock and length."""
    c = F.col
    last = latest(log.filter("tbl = 'edits'"), ["id", "action"], ["seq", "item"])
    per = last.groupBy("id").agg(*(F.max(F.when(c("action") == a, c("value"))).alias(f"e_{a}") for a in ("start_day", "location", "removed_url", "manual_check")))
    rows = listings.join(per, "id")
    shift = F.coalesce(F.datediff(c("e_start_day").cast("date"), F.to_date("start_local")), F.lit(0))
    moved = lambda t: F.timestamp_add("DAY", shift, c(t)).cast("timestamp_ntz").alias(t)
    url: Column = F.when(c("e_removed_url").eqNullSafe(c("url")), F.lit(None).cast("string")).otherwise(c("url"))
    return rows.select("id", moved("start_local"), moved("end_local"), F.coalesce("e_location", "location").alias("location"), url.alias("url"), c("e_removed_url").alias("dropped"), c("e_manual_check").alias("manual_check"))
