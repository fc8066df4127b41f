"""What several operators of this subpackage share: words, folds, word hashes, tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset on one machine (tests) one of our own. On a cluster no
    local folder would be seen by all, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{os.path.join(tempfile.gettempdir(), f'brindle-{os.getpid()}')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_name(docs: DataFrame, name: str) -> str:
    """name, or where docs has a column of it, with underscores behind it. Names differ beyond case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Parts into which the rows of each key are dealt where they are joined by it.
SALTS = 16


def dealt_join(rows: DataFrame, per_key: DataFrame, key: str, salt: str) -> DataFrame:
    """rows joined by key with a table of at most one row for each; dealt by key and a hash of column salt, so that a hot key's rows meet
    in SALTS tasks."""
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS))).join(copies, [key, "_salt"]).drop("_salt")


def words(text: str | None) -> list[bytes]:
    """Words of a text. bytes.split() cuts at just the six bytes that WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def arrow_batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length and size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= limit or size >= max_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WordHashes:
    """64-bit hashes of words, remembered in a table of bounded size."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_start(df: DataFrame, key: str, cell: str, order: list[str], value: Column, out: str, coarse: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sum of value over the rows of the same key that come before, by (cell, order).

    Sums of cells come first, then sums within a cell, so that no task holds all rows of a hot key. coarse: a coarser cell of a cell, in the same order,
    by which the cells of a key are summed in turn, where they are many.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_v", value)
    per = df.groupBy(key, cell).agg(F.sum("_v").alias("_n"))
    if coarse is None:
        before = W.partitionBy(key).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
        base = per.select(key, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    else:
        base = running_start(per.withColumn("_coarse", coarse(F.col(cell))), key, "_coarse", [cell], F.col("_n"), "_from").select(key, cell, F.col("_from").alias("_base"))
    inner = W.partitionBy(key, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    held = df.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return held.join(base, [key, cell]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "_v")
