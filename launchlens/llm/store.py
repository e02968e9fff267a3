"""Cutting lineage through the folder that the session names."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation.

    Where the session names no folder (as in tests), a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Gives back the disk of shuffles whose results are settled.

    Spark removes a shuffle's files once the driver has collected the frames that made it, which a driver
    with little garbage may not do before the job ends. The driver's Python gives up its frames in a thread that looks
    for them every second, so a collection right after Python's own would still find them held; and a single round of both was seen to leave
    the files of the last job.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)
        spark.sparkContext._jvm.System.gc()
