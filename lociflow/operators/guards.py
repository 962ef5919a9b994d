"""Contract guards: actions that fail before anything is written.

A guard is a query of its own that looks for one offending row, since in a lazy
plan the optimizer may drop a check or move a filter below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = ("consensus", "reference")


class ContractError(RuntimeError):
    """Data break a contract."""


class SplitLeakError(ContractError):
    """One place of the genome is in two splits."""


def require_none(bad: DataFrame, message: str, error: type[ContractError] = ContractError) -> None:
    row = bad.limit(1).collect()
    if row:
        raise error(f"{message}: {row[0].asDict()}")


def unapproved_sources(df: DataFrame, approved: tuple[str, ...] = SOURCES) -> DataFrame:
    """Rows whose source label is not approved; a null one is not."""
    return df.where(F.col("source").isNull() | ~F.col("source").isin(*approved))


def require_sources(df: DataFrame, approved: tuple[str, ...] = SOURCES) -> None:
    require_none(unapproved_sources(df, approved).select("source"), f"only the source labels {sorted(approved)} are approved")


def loci_in_two_splits(windows: DataFrame) -> DataFrame:
    return windows.groupBy("locus_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def overlaps_across_splits(windows: DataFrame, bin_size: int) -> DataFrame:
    """Pairs of overlapping windows of a contig in different splits.

    Only bins (and the one before) that hold two splits are joined, on contig and
    bin, so windows may be up to bin_size long; a pair that meets in two bins is
    found once, in the later window's bin.
    """
    keyed = windows.select("contig", "window_start", "window_end", "split").distinct().withColumn("__bin", F.floor(F.col("window_start") / bin_size))
    spread = keyed.withColumn("bin", F.explode(F.array("__bin", F.col("__bin") + 1)))
    mixed = spread.groupBy("contig", "bin").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("contig", "bin")
    held = spread.join(mixed, ["contig", "bin"])
    l, r = held.alias("l"), held.alias("r")
    on = (F.col("l.contig") == F.col("r.contig")) & (F.col("l.bin") == F.col("r.bin")) & (F.col("l.split") < F.col("r.split")) & (F.col("l.window_start") < F.col("r.window_end")) & (F.col("r.window_start") < F.col("l.window_end"))
    once = F.col("l.bin") == F.greatest("l.__bin", "r.__bin")
    names = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("l", "r") for c in ("window_start", "window_end", "split")]
    return l.join(r, on).where(once).select(F.col("l.contig").alias("contig"), *names)


def require_split_safety(windows: DataFrame, bin_size: int) -> None:
    require_none(loci_in_two_splits(windows), "a locus is in two splits", SplitLeakError)
    require_none(overlaps_across_splits(windows, bin_size), "overlapping windows are in two splits", SplitLeakError)


def manifest_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Loci of a batch that an earlier batch put into another split."""
    s = stored.select("locus_id", F.col("split").alias("stored_split"))
    return new.select("locus_id", "split").distinct().join(s, "locus_id").where("split <> stored_split")


def merged_manifest(new: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.unionByName(new).dropDuplicates(["locus_id"])


def shared_contigs(owned: DataFrame, owner: str = "species") -> DataFrame:
    """Contigs with more than one owner."""
    return owned.groupBy("contig").agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def unknown_contigs(records: DataFrame, reference: DataFrame) -> DataFrame:
    return records.select("contig").distinct().join(reference.select("contig"), "contig", "left_anti")


def reference_mismatches(loci: DataFrame) -> DataFrame:
    """Loci (contig, pos, ref, base) whose reference base differs, case aside."""
    return loci.where(F.upper("ref") != F.upper("base"))


def mixed_tokenizers(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("tokenizer").alias("tokenizers")).where("tokenizers > 1")


def require_columns(df: DataFrame, needed: tuple[str, ...]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")


def require_rows(df: DataFrame, message: str) -> None:
    if not df.limit(1).collect():
        raise ContractError(message)
