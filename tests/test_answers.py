"""Answers and what they change, batches with repeated ids, spans of hits."""

import datetime as dt
import time

from brindle.functions.text import highlight_spans
from brindle.operators import answers, lifecycle
from pyspark.sql import functions as F

DAY = dt.datetime(2026, 7, 3, 20)


def listings(spark, *rows):
    fields = "id string, ord long, pool string, source string, name string, location string, url string, start_local timestamp_ntz, end_local timestamp_ntz"
    return spark.createDataFrame([(i, n, pool, "s", name, place, f"https://x.example/{i}", DAY, DAY + dt.timedelta(hours=3)) for n, (i, pool, name, place) in enumerate(rows)], fields)


def test_each_answer_changes_its_tables(spark):
    held = listings(
        spark, ("a", "active", "Harbor Social", "Hall 1"), ("b", "active", "Harbor Social", "Hall 1"), ("c", "pending", "Harbor Anniversary", "Hall 1"), ("d", "pending", "Craft Fair", None), ("e", "archive", "Old Night", "Hall 2"), ("f", "pending", "New Night", "Hall 2"), ("g", "active", "Gone Night", "Hall 3"), ("h", "pending", "Twin", "Hall 9"), ("i", "pending", "Twin", "Hall 9"),
    )
    work = [(1, "active_duplicate", "b", "a"), (2, "possible_duplicate", "c", "a"), (3, "new", "d", None), (4, "possible_duplicate", "f", "e"), (5, "cancelled", "g", None), (6, "date", "a", None), (7, "new", "zz", None), (8, "new", "h", "i"), (9, "new", "i", "h"), (10, "location", "g", None)]
    worklist = spark.createDataFrame([(*w, dt.date(2026, 7, 5) if w[0] == 6 else None, None) for w in work], "item long, kind string, subject string, other string, source_day date, source_place string")
    said = [(1, 1, "different", None), (1, 2, "same", None), (1, 3, "no such choice", None), (2, 1, "same", None), (3, 1, "approve", None), (4, 1, "same", None), (5, 1, "confirm", None), (6, 1, "use_source_date", None), (7, 1, "approve", None), (8, 1, "already_listed", None), (9, 1, "already_listed", None), (10, 1, "keep", " too short ")]
    log = answers.apply_answers(worklist, spark.createDataFrame(said, "item long, seq long, choice string, note string"), held)
    refused = {r.item: r.refused for r in log.collect() if r.refused}
    assert refused == {2: "special edition", 3: "no place", 7: "gone", 10: "no note"}
    pools = {r.id: (r.pool, r.hold, r.merged_into) for r in answers.pools_after(held, log).collect()}
    assert pools["b"] == (None, None, "a") and pools["a"] == ("active", None, None) and pools["f"] == (None, None, "e") and pools["g"] == ("archive", "cancelled", None) and pools["c"][0] == pools["d"][0] == "pending"
    assert pools["h"] == ("pending", None, None) and pools["i"] == ("pending", None, None)
    before = spark.createDataFrame([("a", "b", "different"), ("x", "y", "same")], "a string, b string, verdict string")
    assert {tuple(r) for r in answers.verdicts_after(before, log).collect()} == {("a", "b", "same"), ("x", "y", "same"), ("e", "f", "same"), ("h", "i", "same")}
    edits = {r.id: r for r in answers.edits_after(held, log).collect()}
    assert set(edits) == {"a"} and edits["a"].start_local == DAY + dt.timedelta(days=2) and edits["a"].end_local - edits["a"].start_local == dt.timedelta(hours=3)
    blocks = answers.apply_answers(worklist.filter("item = 3"), spark.createDataFrame([(3, 1, "off_topic", None)], "item long, seq long, choice string, note string"), held)
    kept = spark.createDataFrame([("q", "s", "old|", "elsewhere")], "id string, source string, key string, category string")
    assert {tuple(r) for r in answers.blocks_after(kept, held, blocks).collect()} == {("q", "s", "old|", "elsewhere"), ("d", "s", "craft fair|", "off_topic")}
    assert answers.apply_answers(worklist, spark.createDataFrame([], "item long, seq long, choice string, note string"), held).count() == 0


def test_an_id_twice_in_a_batch_is_added_once(spark):
    fields = "id string, ord long, source string, name string, start_local timestamp_ntz, end_local timestamp_ntz, location string, lat double, lng double, cost string, url string, recurring boolean"
    row = lambda i, n, name, place="Hall 1, Boston, MA": (i, n, "s", name, DAY, DAY + dt.timedelta(hours=3), place, None, None, None, "", False)
    batch = spark.createDataFrame([row("a", 1, "Salsa Lagoon"), row("a", 2, "Salsa Lagoon"), row("b", 3, "Bachata Pier", "Hall 7, Boston, MA")], fields)
    known = spark.createDataFrame([(*row("z", 9, "Zouk Tower", "Hall 5, Boston, MA"), "active")], fields + ", pool string")
    sources = spark.createDataFrame([("s", 1, True, 0)], "source string, source_rank int, trusted boolean, noise int")
    got = {r.ord: (r.id, r.status, r.target, r.other) for r in lifecycle.route(batch, known, sources, F.lit("2026-07-01 12:00:00").cast("timestamp_ntz")).collect()}
    assert got[1] == ("a", "added", "active", None) and got[2] == ("a", "duplicate", None, "a") and got[3][1] in ("added", "pending")


def test_spans_of_hits(spark):
    texts = ["", None, "aaaa", "The theme there", "x the", "ÀTHEÀ the.the", "no hit"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s if r.s is None else [tuple(x) for x in r.s] for r in df.select(highlight_spans(F.col("t"), ["the", "aa", "hem", ""]).alias("s")).collect()]
    assert got == [[], None, [(0, 4)], [(0, 3), (4, 8), (10, 13)], [(2, 5)], [(1, 4), (6, 9), (10, 13)], []]
    assert df.select(highlight_spans(F.col("t"), []).alias("s")).first().s == []


def test_spans_of_a_text_with_very_many_hits(spark):
    n = 200_000
    df = spark.createDataFrame([("the x " * n,)], "t string")
    began = time.time()
    last = df.select(highlight_spans(F.col("t"), ["the", "he"]).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    assert (last.n, tuple(last.last)) == (n, (6 * n - 6, 6 * n - 3))
    assert time.time() - began < 30  # the work was the square of the hits
