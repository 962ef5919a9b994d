"""FASTA files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.guards import ContractError, require_none, require_rows


def scan(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """contig, header, sequence and path of each record; gzip is told by the suffix.

    Records are cut by the reader at a line that begins with `>`, so a file is
    not held whole, and no record is shuffled; a record is one row of at most
    2 GB. The contig is the header's first word. Lines are joined without white
    space at their ends. strict fails on text before the first header and on
    files without records; otherwise such text is skipped, and of contigs with
    one name the last in the files stays.
    """
    first = _first_lines(spark, path)
    headless = first.where(~F.col("line").startswith(">"))
    if strict:
        require_none(headless, "sequence data before the first FASTA header")
        require_rows(first, f"no FASTA record in {path}")
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("__order"))
    rows = rows.where(F.btrim("value", F.lit(BLANK)) != "")
    if not strict:
        # the separator takes the mark of every record but a file's first: without one, what comes first is no record
        lead = rows.groupBy("path").agg(F.min("__order").alias("__order")).join(headless.select("path"), "path")
        rows = rows.join(F.broadcast(lead.select("__order")), "__order", "left_anti")  # one row for each file
    text = F.regexp_replace("value", r"^\s*>", "")
    rows = rows.select("path", "__order", text.alias("__text")).withColumn("__cut", F.instr("__text", "\n"))
    head = F.btrim(F.substring_index("__text", "\n", 1), F.lit(BLANK))
    body = F.when(F.col("__cut") > 0, F.substring(F.col("__text"), F.col("__cut") + 1, F.lit((1 << 31) - 1))).otherwise("")
    out = rows.select(F.regexp_extract(head, r"^\S+", 0).alias("contig"), head.alias("header"), F.btrim(F.regexp_replace(body, r"[ \t\r]*\n[ \t]*", ""), F.lit(BLANK)).alias("sequence"), "path", "__order")
    if not strict:
        out = out.groupBy("contig").agg(*(F.max_by(c, "__order").alias(c) for c in ("header", "sequence", "path")))
    return out.drop("__order")


BLANK = " \t\r\n"


def _first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and first line that is not blank, of each file that has one; tasks send one line for each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.btrim("value", F.lit(BLANK)).alias("line"), F.monotonically_increasing_id().alias("order"))
    return lines.where("line <> ''").groupBy("path").agg(F.min_by(F.substring("line", 1, 200), "order").alias("line"))


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contig and path of each header line; sequences are not kept."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.col("value").startswith(">"))
    return lines.select(F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("contig"), F.substring("value", 2, 1 << 30).alias("header"), "path")


def tiles(reference: DataFrame, size: int = 65_536, overlap: int = 512) -> DataFrame:
    """contig, tile, tile_start, contig_length and bases: parts of contigs with an overlap.

    A join on (contig, tile) then moves a tile for a locus, not a contig.
    """
    n = F.length("sequence")
    t = reference.where(n > 0).select("contig", F.upper("sequence").cast("binary").alias("__bytes"), n.cast("long").alias("contig_length"))
    t = t.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("contig_length") - 1) / size))))
    start = F.greatest(F.lit(0).cast("long"), F.col("tile") * size - overlap)
    end = F.least(F.col("contig_length"), (F.col("tile") + 1) * size + overlap)
    return t.select("contig", "tile", start.alias("tile_start"), "contig_length", F.substring("__bytes", start.cast("int") + 1, (end - start).cast("int")).cast("string").alias("bases"))


def require_evidence(reference: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...] = ()) -> None:
    """Fail unless some header names the reference."""
    from lociflow.functions.variants import evidence_matches

    if not reference.where(evidence_matches(F.col("header"), positive, negative)).limit(1).collect():
        raise ContractError(f"no header shows the reference {positive}")
