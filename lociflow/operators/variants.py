"""From variant calls to allele windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import variants as V
from lociflow.operators.guards import ContractError, reference_mismatches, require_none, unknown_contigs


def passing_snps(calls: DataFrame, on_bad: str = "raise", check: bool = True) -> DataFrame:
    """Calls at passing, biallelic, single-base sites.

    on_bad="raise" fails on other letters than ACGTN in a passing SNP, "skip"
    drops them. Checks come in the order column, filter, alleles, so a site that
    does not pass is dropped whatever its alleles.
    """
    snps = calls.where(V.passing(F.col("filter")) & V.is_snp(F.col("ref"), F.col("alt")))
    good = V.known_alleles(F.col("ref"), F.col("alt"))
    if on_bad == "raise" and check:
        require_none(snps.where(~good).select("contig", "pos", "ref", "alt"), "alleles outside ACGTN")
    return snps.where(good)


def with_reference(loci: DataFrame, tiles: DataFrame, tile_size: int) -> DataFrame:
    """Loci (contig, pos) with the tile that holds them, joined on contig and tile: no contig is replicated."""
    t = tiles.withColumnRenamed("contig", "__contig").withColumnRenamed("tile", "__tile_no")
    on = (F.col("contig") == F.col("__contig")) & (F.floor((F.col("pos") - 1) / tile_size) == F.col("__tile_no"))
    joined = loci.join(t, on).drop("__contig", "__tile_no")
    base = F.substring(F.col("bases").cast("binary"), (F.col("pos") - F.col("tile_start")).cast("int"), F.lit(1)).cast("string")
    return joined.withColumn("base", base)


#: What is wrong with a call at a passing SNP, in the order in which it is told.
OFFENCES = ("alleles outside ACGTN", "FORMAT holds no GT", "malformed genotype", "genotype is not diploid")


def _first_offence(calls: DataFrame) -> str | None:
    """The first of OFFENCES that some call with `gt` commits, and the first such call."""
    tests = (~V.known_alleles(F.col("ref"), F.col("alt")), ~F.array_contains(F.split("format", ":"), "GT"), V.malformed_gt(F.col("gt")), F.size(V.gt_tokens(F.col("gt"))) != 2)
    which = None
    for i, test in enumerate(tests):
        which = F.when(test, i) if which is None else which.when(test, i)
    snps = calls.where(V.passing(F.col("filter")) & V.is_snp(F.col("ref"), F.col("alt")))
    worst = snps.select(F.struct(which.alias("which"), "line_no", "contig", "pos", "ref", "alt", "sample_id", "format", "gt").alias("row")).where("row.which IS NOT NULL").agg(F.min("row")).first()[0]
    return f"{OFFENCES[worst.which]}: {({k: v for k, v in worst.asDict().items() if k != 'which'})}" if worst else None


def allele_windows(calls: DataFrame, tiles: DataFrame, tile_size: int, check: bool = True) -> DataFrame:
    """One window for each carried allele of each call, reference before alternate.

    calls: line_no, contig, pos, ref, alt, filter, format, field, sample_id. Fails
    on unknown contigs, foreign alleles, missing GT keys, malformed or
    non-diploid calls, and a reference base other than REF, in this order;
    missing and homozygous-reference calls have no window, nor do loci too near
    a contig's end. The checks of rows are one pass over the calls: each row has
    its first offence, and the least of all is told; contigs and reference bases
    take a join each.
    """
    calls = calls.withColumn("gt", V.format_value(F.col("format"), F.col("field")))
    if check:
        require_none(unknown_contigs(calls, tiles), "a record's contig is not in the reference")
        offence = _first_offence(calls)
        if offence:
            raise ContractError(offence)
    snps = passing_snps(calls, "raise", check=False)
    carried = snps.withColumn("__carried", V.carried_alleles(F.col("gt"), F.col("ref"), F.col("alt"))).where(F.size("__carried") > 0)
    placed = with_reference(carried, tiles, tile_size)
    if check:
        require_none(reference_mismatches(placed).select("contig", "pos", "ref", "base"), "the reference has another base")
    w = placed.select("*", F.posexplode("__carried").alias("allele_no", "__allele"))
    w = w.withColumn("sequence", V.centred_window(F.col("bases"), F.col("tile_start"), F.col("pos"), F.col("__allele.allele"), F.col("contig_length"))).where("sequence IS NOT NULL")
    return w.select(
        "sample_id", "contig", F.col("pos").alias("locus_pos"), (F.col("pos") - 1 - V.UPSTREAM).alias("window_start"), (F.col("pos") + V.DOWNSTREAM).alias("window_end"), "sequence",
        F.col("ref").alias("ref_allele"), F.col("alt").alias("alt_allele"), F.col("__allele.is_heterozygous").alias("is_heterozygous"), F.col("gt").alias("genotype"), F.col("filter").alias("filter_status"), "line_no", "allele_no",
    )
