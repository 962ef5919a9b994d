"""Locus blocks and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import sequence as S
from lociflow.functions.splits import assign_split, locus_id
from lociflow.plans.contracts import Preprocessing


def blocks(sequences: DataFrame, config: Preprocessing) -> DataFrame:
    """Parts of sequences in blocks of an absolute grid, of at least a window, with locus and split.

    All blocks of a row are cut from its bytes in one expression, so that no
    exploded row carries the contig, and only the block's bases go on. The split
    is hashed once a block. Extra columns are kept.
    """
    size = config.locus_block_size
    if "sequence_start" not in sequences.columns:
        sequences = sequences.withColumn("sequence_start", F.lit(0).cast("long"))
    start = F.col("sequence_start")
    end = (start + F.length("sequence")).cast("long")
    first = F.floor(start / size) * size
    grid = F.when(end > first, F.sequence(first, end - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def cut(bases):
        def one(at):
            a, b = F.greatest(at, start), F.least(at + size, end)
            part = F.substring(bases, (a - start).cast("int") + 1, (b - a).cast("int")).cast("string")
            return F.struct(at.alias("block_start"), (at + size).alias("block_end"), a.alias("overlap_start"), b.alias("overlap_end"), part.alias("sequence"))

        return F.filter(F.transform(grid, one), lambda x: x["overlap_end"] - x["overlap_start"] >= config.window_size)

    others = [c for c in sequences.columns if c not in ("sequence", "sequence_start")]
    s = sequences.select(*others, F.inline(S.let(F.col("sequence").cast("binary"), cut)))
    s = s.withColumn("locus_id", locus_id(F.col("contig"), F.col("block_start"), F.col("block_end")))
    return s.withColumn("split", assign_split(F.col("locus_id"), config.split_weights, config.split_seed))


def windows(block_rows: DataFrame, config: Preprocessing) -> DataFrame:
    """Windows of blocks from the overlap's start, without those of too many N; nothing is padded."""
    starts = F.sequence("overlap_start", F.col("overlap_end") - config.window_size, F.lit(config.window_stride).cast("long"))

    def cut(start):
        return F.struct(start.alias("window_start"), (start + config.window_size).alias("window_end"), S.piece(F.col("sequence"), start - F.col("overlap_start"), F.lit(config.window_size)).alias("sequence"))

    others = [c for c in block_rows.columns if c not in ("sequence", "overlap_start", "overlap_end", "gc_fraction", "ambiguity_fraction")]
    w = block_rows.select(*others, F.inline(F.transform(starts, cut)))
    w = w.withColumn("ambiguity_fraction", S.ambiguity_fraction(F.col("sequence"))).where(F.col("ambiguity_fraction") <= config.max_ambiguity_fraction)
    return w.withColumn("gc_fraction", S.gc_fraction(F.col("sequence"))).withColumn("sequence_hash", S.sequence_hash(F.col("sequence")))


def split_counts(w: DataFrame, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Windows and bases of each split; splits without windows count 0."""
    counts = w.groupBy("split").agg(F.count("*").alias("windows"), F.sum(F.length("sequence")).alias("bases"))
    names = w.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return names.join(counts, "split", "left").select("split", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("bases", F.lit(0)).alias("bases"))


def split_manifest(w: DataFrame) -> DataFrame:
    """Different loci with their split."""
    return w.select("locus_id", "contig", "block_start", "block_end", "split").distinct()
