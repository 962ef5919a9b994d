"""VCF files as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.guards import ContractError, require_none

FIXED = ("contig", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


@dataclass(frozen=True)
class Header:
    """What the header lines of a VCF say."""

    reference: str | None
    contigs: tuple[str, ...]
    samples: tuple[str, ...]


def header(spark: SparkSession, path: str, first: int = 1024) -> Header:
    """The header: the file's first lines up to #CHROM, read `first` at a time and then ever more, not the records."""
    rows = spark.read.text(path)
    while True:
        got = [r[0] for r in rows.take(first)]
        end = next((i for i, x in enumerate(got) if x.startswith("#CHROM")), None)
        if end is not None or len(got) < first or not got[-1].startswith("#"):
            break
        first *= 4
    if end is None:
        raise ContractError(f"{path} has no #CHROM line")
    reference = next((x.partition("=")[2].strip() for x in got[:end] if x.startswith("##reference=")), None)
    contigs = tuple(x[len("##contig=<ID=") :].split(",")[0].split(">")[0] for x in got[:end] if x.startswith("##contig=<ID="))
    return Header(reference, contigs, tuple(got[end].rstrip("\r").split("\t")[9:]))


def records(spark: SparkSession, path: str, head: Header, on_bad: str = "raise") -> DataFrame:
    """The fixed columns, an array of sample fields, and line_no, which grows in file order.

    on_bad="raise" fails on rows of another number of columns than the header;
    "skip" drops those with less than the fixed ones.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    cut = lines.select(F.split(F.rtrim(F.regexp_replace("value", r"\r$", "")), "\t").alias("f"), F.monotonically_increasing_id().alias("line_no"))
    if on_bad == "raise":
        require_none(cut.where(F.size("f") != len(FIXED) + len(head.samples)).select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).alias("pos"), F.size("f").alias("columns")), "malformed VCF row")
    elif on_bad == "skip":
        cut = cut.where(F.size("f") >= len(FIXED))
    else:
        raise ValueError("on_bad must be 'raise' or 'skip'")
    fixed = [F.get("f", F.lit(i)).alias(c) for i, c in enumerate(FIXED)]
    return cut.select("line_no", *fixed, F.slice("f", len(FIXED) + 1, F.greatest(F.lit(0), F.size("f") - len(FIXED))).alias("fields")).withColumn("pos", F.col("pos").cast("long"))


def calls(rows: DataFrame, head: Header, samples: list[str] | None = None) -> DataFrame:
    """One row for each record and sample: the file is read once for all samples."""
    names = F.array(*map(F.lit, head.samples)) if head.samples else F.array().cast("array<string>")
    long = rows.select("*", F.posexplode("fields").alias("sample_no", "field")).drop("fields").withColumn("sample_id", F.get(names, F.col("sample_no")))
    return long.where(F.col("sample_id").isin(samples)) if samples is not None else long
