"""Tables that are computed once: kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed: its lineage is cut and a lost executor doesn't bring it back to its sources.

    The folder is that of spark.checkpoint.dir. A session on one machine gets one of its own where that is unset; on a cluster
    no local folder would be seen by all, so it is an error there.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='brindle-')}")
    return df.checkpoint()
