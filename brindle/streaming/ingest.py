"""Streams: routing of new files, first-seen times, daily health of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.lifecycle import route, upserts
from ..operators.match import latest
from ..operators.stage import kept

#: Rows later than this are dropped: the grace that batch runs give past rows.
GRACE = "24 hours"


def stream_ingest(new: DataFrame, known: Callable[[], DataFrame], sources: DataFrame, as_of: Column, out: str, checkpoint: str) -> StreamingQuery:
    """Routes each micro-batch as the batch job does and appends id, status, target to a Parquet table, a folder per batch, so that a batch that
    is run again replaces its own rows."""

    def routed(batch: DataFrame, number: int) -> None:
        route(batch, known(), sources, as_of).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new.writeStream.foreachBatch(routed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inbox(spark: SparkSession, folder: str, archive: str, schema: StructType) -> DataFrame:
    """New JSON files of a folder as a stream; files that were read move to the archive, so that listing the folder stays cheap."""
    return spark.readStream.schema(schema).option("multiLine", True).option("cleanSource", "archive").option("sourceArchiveDir", archive).json(folder)


def pools_before(base: DataFrame, out: str, batch: int | None = None) -> DataFrame:
    """base with what batches before this one (all, without one) changed: of each id the row of the last batch. Rows that no batch changed are found by an anti-join, so
    the pools aren't sorted for each batch."""
    try:
        log = base.sparkSession.read.schema(StructType([*base.schema.fields]).add("batch", "long")).parquet(f"{out}/changes")
    except AnalysisException:
        return base
    if batch is not None:
        log = log.filter(F.col("batch") < batch)
    last = latest(log, ["id"], ["batch"]).drop("batch")
    return base.join(last.select("id"), "id", "left_anti").unionByName(last)


def stream_pools(new: DataFrame, base: DataFrame, sources: DataFrame, as_of: Column, out: str, checkpoint: str) -> StreamingQuery:
    """Routes each micro-batch against the pools as the batches before it left them, and writes what it changes and where its rows went, a folder per batch: a batch that
    is run again sees what it saw, and replaces its own rows. pools_before(base, out) are the pools so far."""

    def upsert(batch: DataFrame, number: int) -> None:
        rows, known = kept(batch), pools_before(base, out, number)
        routed = route(rows, known, sources, as_of)
        routed.write.mode("overwrite").parquet(f"{out}/routes/batch={number}")
        routed = batch.sparkSession.read.schema(routed.schema).parquet(f"{out}/routes/batch={number}")
        upserts(rows, routed, known, sources).select(*base.columns).write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    return new.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first_seen(rows: DataFrame, id_column: str = "id", seen: str = "seen_at") -> DataFrame:
    """The first row of each id within the grace; later copies of it are updates, not arrivals."""
    return rows.withWatermark(seen, GRACE).dropDuplicatesWithinWatermark([id_column])


def refresh(known: DataFrame, batch: DataFrame) -> DataFrame:
    """known with the batch's content by id, the time first seen kept."""
    first = known.select("id", "seen_at").unionByName(batch.select("id", "seen_at")).groupBy("id").agg(F.min("seen_at").alias("first_seen"))
    newest = latest(known.unionByName(batch), ["id"], ["seen_at"])
    return newest.join(first, "id").withColumn("seen_at", F.col("first_seen")).drop("first_seen")


def stream_health(rows: DataFrame, at: str = "ts") -> DataFrame:
    """source, day, n per tumbling day; rows later than the grace are dropped."""
    counts = rows.withWatermark(at, GRACE).groupBy("source", F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counts.select("source", F.col("w.start").alias("day"), "n")
