"""Cutting the lineage of a frame that several jobs read."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame

__all__ = ["materialize"]


def materialize(df: DataFrame) -> DataFrame:
    """Compute a frame once, into the checkpoint folder the cluster names.

    A checkpoint lives in shared storage and so outlives lost executors, and its plan is
    a scan: plans that read a frame twice do not double with every step. Where no
    folder is named, a local session gets a temporary one; on a cluster, whose
    machines share none, the frame is cached, and Spark recomputes what is lost.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
