"""Pools, scraped files, snapshots and logs in files."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_pool(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A pool's JSON. A missing file is an empty pool; one that can't be parsed is an error, never an empty pool."""
    try:
        files = spark.read.format("binaryFile").load(path).agg(F.count("*").alias("n"), F.min("length").alias("least")).first()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if not files["n"] or not files["least"]:  # a file without bytes may have no row here
        raise ValueError(f"{path} is empty, or holds an empty file")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_scraped(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """All sources' files but *-raw.json: their rows, and the names of files that can't be parsed."""
    wide = StructType([*schema.fields]).add("_corrupt", "string")
    rows = spark.read.schema(wide).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).filter(~F.col("_file").endswith("-raw.json")).cache()
    return rows.filter("_corrupt is null").drop("_corrupt", "_file"), rows.filter("_corrupt is not null").select(F.element_at(F.split("_file", "/"), -1).alias("file")).distinct()


def write_snapshot(df: DataFrame, path: str, version: str | None = None) -> str:
    """Replaces a snapshot all or nothing: the rows go to a folder of their own, then the pointer, one small file, names it."""
    version = version or f"v{int(time.time() * 1000)}"
    df.write.parquet(f"{path}/{version}")
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pointer = hadoop.Path(f"{path}/.current-{uuid.uuid4().hex}")
    out = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(pointer)
    out.write(bytearray(version.encode()))
    out.close()
    _rename(spark, pointer.toString(), f"{path}/CURRENT")
    return version


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file over another in one step, so that there is always one of them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(old), hadoop.Path(new)
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, over)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}")


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def publish_files(feed: DataFrame, slugs: DataFrame, path: str) -> None:
    """The feed as JSON, its rows that aren't archived, and the site map as XML lines."""
    feed.write.mode("overwrite").json(f"{path}/events")
    feed.filter("not archived").write.mode("overwrite").json(f"{path}/events-upcoming")
    escaped = F.replace(F.replace("loc", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    slugs.select(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>")).alias("value")).write.mode("overwrite").text(f"{path}/sitemap")
