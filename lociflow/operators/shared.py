"""Cutting lineage by the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir, so that its rows and their partitions stay as they are.

    A folder of its own is made only where none is set, in local mode.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="lociflow-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, small: int = 64 << 20) -> DataFrame:
    """A table of less than `small` bytes dealt out to all cores; others keep the partitions of their files.

    A small file is one task however costly the work on its rows is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df
