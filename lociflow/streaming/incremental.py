"""Incremental corpus building: new sequence files become windows as they come."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lociflow.operators import guards, intervals, prepare, windows
from lociflow.plans.contracts import Preprocessing


def _others(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """Rows of the other batches in a folder; None if it has no batch yet."""
    try:
        return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").where(F.col("batch") != number)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _near(found: DataFrame, stored: DataFrame, size: int) -> DataFrame:
    """A batch's windows, and the stored ones of bins in or beside which it has a window."""
    columns = ["contig", "window_start", "window_end", "split"]
    bin_ = F.floor(F.col("window_start") / size)
    bins = found.select("contig", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("__bin")).distinct()
    held = stored.withColumn("__bin", bin_).join(bins, ["contig", "__bin"], "left_semi")
    return found.select(*columns).unionByName(held.select(*columns))


def follow(spark: SparkSession, folder: str, schema: str, config: Preprocessing, output: str, checkpoint: str) -> StreamingQuery:
    """Read what is new in a folder of Parquet sequence records, and stop when it is written.

    Each batch has a folder named by its number and is written with overwrite, so a
    batch that runs again after a failure replaces itself. Its split manifest is
    stored beside it, in _manifest, which readers of the windows pass over. A
    batch with a locus that another batch's manifest has in another split, or a
    window that overlaps another batch's window of another split, fails before
    it is written.
    """

    def batch(rows: DataFrame, number: int) -> None:
        retained, _ = prepare.prepare(rows, config)
        found = windows.windows(windows.blocks(retained, config), config)
        if "mask_spans" in rows.columns:
            found = intervals.with_masks(found)
        guards.require_split_safety(found, config.locus_block_size)
        session = rows.sparkSession
        if (manifest := _others(session, f"{output}/_manifest", number)) is not None:
            guards.require_none(guards.manifest_conflicts(found, manifest), "a stored locus is in another split", guards.SplitLeakError)
        if (stored := _others(session, output, number)) is not None:
            guards.require_none(guards.overlaps_across_splits(_near(found, stored, config.locus_block_size), config.locus_block_size), "a stored window of another split overlaps", guards.SplitLeakError)
        found.write.mode("overwrite").parquet(f"{output}/batch={number}")
        # read back, so that the manifest is of what is stored
        windows.split_manifest(session.read.parquet(f"{output}/batch={number}")).write.mode("overwrite").parquet(f"{output}/_manifest/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
