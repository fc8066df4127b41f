"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, running_start, staged

#: The golden ratio's step among 2**31 points: i * STEP mod 2**31 visits every point once in 2**31 slots.
POINTS, STEP = 1 << 31, 1_327_217_885
#: A source's words are used at most this many times.
MOST_PASSES = 3
CELL_BITS = 21
#: Hexadecimal digits of a document's shuffle key that tell its run: a source has 16 to that power of runs, summed by half the digits first.
RUN_DIGITS = 6


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)).alias("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: sid, source, source_size, target (words).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by weight; one that
    would pass MOST_PASSES times its source's size stops there and the others share what is left. Sorted by cap per
    weight, the sources that stop are a prefix, so one running sum finds the level at which none is above.
    The windows without a key run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.select("source", "source_size", F.row_number().over(by_name).alias("sid")).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    everything = W.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("cap", F.col("source_size") * MOST_PASSES)
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = W.orderBy("ratio", "sid")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / left)
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)
    return per.select("sid", "source", "source_size", "total", F.least(F.col("cap").cast("double"), reached["level"] * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, total: int, block_words: int) -> DataFrame:
    """Per slot of the mix: slot, sid, block. Slot i takes the golden-ratio point i through the cumulative targets; the
    slots of a source, ranked, take its blocks in order."""
    by_sid = W.orderBy("sid")
    high = F.floor(F.sum("target").over(by_sid) / F.lit(float(max(total, 1))) * POINTS).cast("long")
    bounds = targets.withColumn("high", F.when(F.lead("sid").over(by_sid).isNull(), F.lit(POINTS)).otherwise(high))
    bounds = bounds.select("sid", F.coalesce(F.lag("high").over(by_sid), F.lit(0)).alias("low"), "high").filter("high > low")
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))))
    slots = targets.sparkSession.range(-(-total // block_words)).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", F.col("slot") % POINTS * STEP % POINTS).withColumn("cell", F.shiftright("point", CELL_BITS))
    placed = slots.join(bounds, "cell").filter("point >= low AND point < high").select("slot", "sid")
    return running_start(placed.withColumn("run", F.shiftright("slot", 12)), "sid", "run", ["slot"], F.lit(1), "block").select("slot", "sid", "block")


def mix_passes(docs: DataFrame, block_words: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """What the mix takes of each document: the document's row (row, doc_id, source, size, source_size, target), pass, begin and end in its source's
    row of words (one with pass null for a document that is not taken); the slots of the mix; words of a block."""
    sizes = staged(sized(docs), "mix-sizes")
    targets = staged(source_targets(sizes), "mix-targets")
    first = targets.select("total").first()
    total = int(first["total"]) if first else 0
    size_of_block = block_words or max(1, min(2048, total // 65536))
    slots = staged(schedule(targets, total, size_of_block), "mix-slots")
    counts = slots.groupBy("sid").agg((F.max("block") + 1).alias("blocks"))
    plan = targets.join(counts, "sid", "left").select(
        "sid", F.col("source").alias("_s"), "source_size", "target",
        F.least(F.coalesce("blocks", F.lit(0)) * size_of_block, F.col("source_size") * MOST_PASSES).alias("taken_words"),
    )
    rows = sizes.withColumn("row", F.monotonically_increasing_id()).join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("shuffle", F.md5(F.col("doc_id").cast("string").cast("binary"))).fillna("", ["shuffle"])
    rows = rows.withColumn("run", F.substring("shuffle", 1, RUN_DIGITS))
    rows = running_start(rows, "sid", "run", ["shuffle", "doc_id", "size", "row"], F.col("size"), "start", lambda run: F.substring(run, 1, RUN_DIGITS // 2))
    passes = F.when((F.col("size") > 0) & (F.col("start") < F.col("taken_words")), F.sequence(F.lit(0).cast("long"), F.least(F.lit(MOST_PASSES - 1).cast("long"), F.expr("(taken_words - start - 1) div greatest(source_size, 1)"))))
    rows = rows.withColumn("pass", F.explode_outer(passes)).withColumn("begin", F.col("pass") * F.col("source_size") + F.col("start"))
    return rows.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("taken_words"))), slots, size_of_block


def mix_pieces(docs: DataFrame, block_words: int | None = None) -> DataFrame:
    """The mix: per document and slot that takes words of it: the document's row, slot, first_word (of the document),
    n_words; a row with slot null and n_words 0 for a document that is not taken.

    Within its source, documents are shuffled by md5 of the id and laid end to end, MOST_PASSES times; block b is the
    words [b * block_words, (b + 1) * block_words) of that. block_words: by default 1 / 65536 of all words, at most 2048.
    Null or empty texts have size 0 and are never taken; repeated rows count as separate documents; null sources
    form one source; other columns are ignored; an empty table gives no rows.
    """
    rows, slots, size_of_block = mix_passes(docs, block_words)
    block = F.sequence(F.expr(f"begin div {size_of_block}"), F.expr(f"(end - 1) div {size_of_block}"))
    rows = rows.withColumn("block", F.explode_outer(F.when(F.col("pass").isNotNull(), block)))
    from_, to = F.greatest("begin", F.col("block") * size_of_block), F.least("end", (F.col("block") + 1) * size_of_block)
    joined = rows.join(slots, ["sid", "block"], "left")
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", "slot", "pass", (from_ - F.col("begin")).alias("first_word"), F.when(F.col("slot").isNotNull(), to - from_).otherwise(0).alias("n_words"))


def mix_taken(docs: DataFrame, block_words: int | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken. See mix_pieces for nulls, repeats and empty tables."""
    same: list[Column] = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return mix_pieces(docs, block_words).groupBy("row").agg(*same, F.sum("n_words").cast("long").alias("taken")).drop("row")


def mix_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes, as documents with the columns of docs: one for each pass that takes a document. A pass takes it whole, but where the
    source's share ends within it: then the text is its first words, joined by a space.

    A null or empty text is never taken. Rows that repeat a doc_id are documents of their own; those without doc_id are mixed like others; null
    sources form one source; other columns are carried whatever their names; an empty table gives no rows.
    """
    taken = mix_passes(docs)[0].filter("pass is not null").select("doc_id", "size", "source", "row", (F.col("end") - F.col("begin")).alias("_words"))
    same = ["doc_id", "size", "source"]  # rows alike in these stand for each other
    taken = taken.select(*(F.col(c).alias(f"_{c}") for c in same), "_words", F.dense_rank().over(W.partitionBy(*same).orderBy("row")).alias("_k"))
    rows = docs.select("doc_id", "source", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)).alias("_n"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy("doc_id", "_n", "source").orderBy("text")))
    c = F.col
    met = rows.join(taken, c("doc_id").eqNullSafe(c("_doc_id")) & (c("_n") == c("_size")) & c("source").eqNullSafe(c("_source")) & (c("_i") == c("_k")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), c("_words").cast("int")), " ")
    text = F.when(c("_words") < c("_n"), cut).otherwise(c("text"))
    return met.select(*((text if name == "text" else c("_row")[name]).alias(name) for name in docs.columns))


ORACLE = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight, sum(source_size) OVER ()::BIGINT AS total, 3 * source_size AS cap FROM per),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
reached AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, sid LIMIT 1),
t AS (SELECT l.*, least(cap::DOUBLE, (SELECT level FROM reached) * weight) AS target, greatest(1, least(2048, total // 65536)) AS b FROM l),
c AS (SELECT *, CASE WHEN lead(sid) OVER (ORDER BY sid) IS NULL THEN 2147483648
    ELSE floor(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / greatest(total, 1) * 2147483648)::BIGINT END AS high FROM t),
bounds AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM c),
points AS (SELECT i % 2147483648 * 1327217885 % 2147483648 AS p FROM (SELECT unnest(range((max(total) + max(b) - 1) // max(b))) AS i FROM t)),
counts AS (SELECT sid, count(*) AS n FROM points JOIN bounds ON p >= low AND p < high GROUP BY sid),
plan AS (SELECT t.sid, t.source, source_size, target, least(coalesce(n, 0) * b, cap) AS lim FROM t LEFT JOIN counts USING (sid)),
pos AS (SELECT s.doc_id, s.size, source_size, target, lim, coalesce(sum(s.size) OVER (PARTITION BY sid ORDER BY md5(s.doc_id::VARCHAR), s.doc_id, s.size, rid
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM sized s JOIN plan ON s.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
  (least(greatest(lim - a, 0), size) + least(greatest(lim - source_size - a, 0), size) + least(greatest(lim - 2 * source_size - a, 0), size))::BIGINT AS taken FROM pos
"""
