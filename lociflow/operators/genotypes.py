"""The genotype matrix as a long table, its frequencies and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import variants as V
from lociflow.operators.guards import ContractError, require_none, require_rows
from lociflow.operators.variants import passing_snps


def matched_samples(samples: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(in both, samples without metadata, metadata without sample)."""
    return samples.join(metadata, "sample_id"), samples.join(metadata, "sample_id", "left_anti"), metadata.join(samples, "sample_id", "left_anti")


def loci(snps: DataFrame) -> DataFrame:
    """Different records with locus_key; their order is that of the file."""
    return snps.select("line_no", "contig", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).distinct().withColumn("locus_key", F.concat_ws(":", "contig", F.col("pos").cast("string")))


def long_matrix(calls: DataFrame, metadata: DataFrame, check: bool = True) -> DataFrame:
    """individual_id, sample_id, contig, pos, line_no and g (null: missing) of matched samples at passing SNPs.

    Rows without GT in FORMAT or with foreign alleles are skipped, malformed
    calls fail. The matrix stays long: 83,000 columns of a pivot would not plan.
    """
    snps = passing_snps(calls, "skip").where(F.array_contains(F.split("format", ":"), "GT"))
    joined = snps.join(metadata.select("sample_id", "individual_id"), "sample_id")
    if check:
        require_rows(joined, "no sample is in both the calls and the metadata")
    joined = joined.withColumn("gt", V.format_value(F.col("format"), F.col("field")))
    if check:
        require_none(joined.where(V.malformed_gt(F.col("gt"))).select("contig", "pos", "sample_id", "gt"), "malformed genotype")
    return joined.select("individual_id", "sample_id", "contig", "pos", "line_no", V.genotype(F.col("gt")).cast("tinyint").alias("g"))


def dense_rows(matrix: DataFrame, row: str = "sample_id", order: str = "line_no") -> DataFrame:
    """One row for each individual with genotypes in locus order, -1 for missing."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("g", F.lit(-1)).cast("tinyint").alias("g"))))
    return matrix.groupBy(row).agg(F.transform(cells, lambda c: c["g"]).alias("genotypes"))


def allele_frequency(matrix: DataFrame, locus: str = "locus_key") -> DataFrame:
    """Alternate allele frequency over known genotypes; 0 without any."""
    n = F.count("g")
    return matrix.groupBy(locus).agg(F.when(n == 0, 0.0).otherwise(F.sum(F.col("g").cast("long")) / (2 * n)).alias("frequency"), n.alias("known"))


def leave_one_out_frequency(matrix: DataFrame, locus: str = "locus_key") -> DataFrame:
    """Each cell with the frequency over the other individuals: totals less its own, one pass for all folds."""
    totals = matrix.groupBy(locus).agg(F.coalesce(F.sum(F.col("g").cast("long")), F.lit(0)).alias("__sum"), F.count("g").alias("__n")).withColumnRenamed(locus, "__locus")
    own, one = F.coalesce(F.col("g").cast("long"), F.lit(0)), F.when(F.col("g").isNull(), 0).otherwise(1)
    left = F.col("__n") - one
    return matrix.join(totals, F.col(locus) == F.col("__locus")).withColumn("frequency", F.when(left == 0, 0.0).otherwise((F.col("__sum") - own) / (2 * left))).drop("__sum", "__n", "__locus")


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and parts: the same on every run and machine."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def imputed(cells: DataFrame, seed: int, row: str = "individual_id", locus: str = "locus_key") -> DataFrame:
    """Cells with g filled where missing: two draws of an allele with the cell's frequency."""
    one = lambda k: F.when(draw(seed, F.col(row), F.col(locus), F.lit(k)) < F.col("frequency"), 1).otherwise(0)
    return cells.withColumn("g_imputed", F.coalesce(F.col("g").cast("int"), one(0) + one(1)))


def require_samples(matched: DataFrame) -> None:
    if not matched.limit(1).collect():
        raise ContractError("no sample is in both the calls and the metadata")
