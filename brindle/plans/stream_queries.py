"""Streams run to their end over the event files: the rows are those of the batch form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import with_views
from ..streaming.ingest import stream_first_seen, stream_health
from .registry import ORACLE_SQL, QUERIES


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='brindle-')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return rows.withColumn("source", F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string"))).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a stream appends, a folder per batch."""
    at = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    rows.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are over by the grace: rows that come later than that are dropped, so a day is told once."""
    out = _run(spark, stream_health(_events(spark, sf_dir)))
    return out.select("source", F.col("day").cast("timestamp_ntz").alias("day"), "n")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time of each series; copies within the grace are told apart by the stream's state alone."""
    rows = _events(spark, sf_dir).withColumn("id", F.concat_ws("|", "user_id", "event_type"))
    return _run(spark, stream_first_seen(rows, "id", "ts")).select("id")


QUERIES["stream_health"] = health
ORACLE_SQL["stream_health"] = with_views("SELECT source, date_trunc('day', occ_local)::TIMESTAMP AS day, count(*) AS n FROM v_series GROUP BY 1, 2 HAVING date_trunc('day', occ_local)::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(occ_local) FROM v_series) - INTERVAL 24 HOUR")
QUERIES["stream_first_seen"] = first_seen
ORACLE_SQL["stream_first_seen"] = with_views("SELECT DISTINCT series_id AS id FROM v_series")
