"""The corpus pipeline: FASTA files to tokenised, split-safe windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.tokens import stride_tokenizer, tokenize
from lociflow.operators import guards, intervals, prepare, windows
from lociflow.operators.shared import settled
from lociflow.plans.config import CorpusPlan, Species
from lociflow.plans.contracts import Preprocessing, Tokenizer
from lociflow.sources import corpus, fasta


def species_sequences(spark: SparkSession, s: Species) -> DataFrame:
    """A species' contigs as sequence records."""
    rows = fasta.scan(spark, s.fasta)
    spans = F.array().cast("array<struct<start:bigint,end:bigint,category:string>>")
    return rows.select(F.lit(s.sample_id).alias("sample_id"), F.lit(s.individual_id).alias("individual_id"), "contig", "sequence", F.lit("reference").alias("source"), F.lit(0).cast("long").alias("sequence_start"), spans.alias("mask_spans"))


def corpus_windows(sequences: DataFrame, config: Preprocessing, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(windows with masks, rejected sequences) of sequence records: one lazy plan without a shuffle."""
    retained, rejected = prepare.prepare(sequences, config, check)
    found = windows.windows(windows.blocks(retained, config), config)
    return intervals.with_masks(found), rejected


def run(spark: SparkSession, plan: CorpusPlan, tokenizer: Callable[[str], list[int]] = stride_tokenizer, provenance: Tokenizer = Tokenizer()) -> DataFrame:
    """Build the corpus; returns counts by species.

    Contigs must have one owner, told from headers before any work. Species that
    the stored counts name as done are left out; one that failed is written anew
    in its own folder, so no run leaves rows twice. The manifest comes last.
    """
    done = _done(spark, plan.output)
    owned = None
    for s in plan.species:
        h = fasta.headers(spark, s.fasta).select("contig", F.lit(s.name).alias("species"))
        owned = h if owned is None else owned.unionByName(h)
    guards.require_none(guards.shared_contigs(owned), "a contig has two species")
    for s in plan.species:
        if s.name in done:
            continue
        found, rejected = corpus_windows(species_sequences(spark, s), plan.preprocessing)
        tokens = settled(corpus.exported(tokenize(found, tokenizer, provenance.max_tokens), plan.export, provenance, keep_sequence=True))
        guards.require_rows(tokens, f"{s.name} has no windows")
        flat = tokens.select("split", *(f"window.{c}" for c in ("locus_id", "contig", "block_start", "block_end", "window_start", "window_end")), F.length("window.sequence").alias("bases"))
        guards.require_split_safety(flat.drop("bases"), plan.preprocessing.locus_block_size)
        folder, manifest = f"{plan.output}/species={s.sample_id}", windows.split_manifest(flat)
        if plan.export.format == "webdataset":  # shards always hold the raw windows
            corpus.write_shards(tokens, folder, plan.export, manifest)
        else:
            final = tokens if plan.export.keep_sequence else tokens.withColumn("window", F.col("window").dropFields("sequence"))
            corpus.write(final, folder, plan.export, manifest, mode="overwrite")
        counts = flat.groupBy("split").agg(F.count("*").alias("windows"), F.sum("bases").alias("bases")).select(F.lit(s.name).alias("species"), "split", "windows", "bases")
        reasons = rejected.groupBy("reason").count()
        reasons.write.mode("overwrite").json(f"{plan.output}/_rejected/{s.sample_id}")
        counts.coalesce(1).write.mode("overwrite").json(f"{plan.output}/_done/{s.sample_id}")
    return spark.read.json(f"{plan.output}/_done/*")


def _done(spark: SparkSession, output: str) -> set[str]:
    """Species whose counts are stored: a handful of names."""
    from pyspark.errors import AnalysisException

    try:
        return {r[0] for r in spark.read.json(f"{output}/_done/*").select("species").distinct().collect()}
    except AnalysisException:
        return set()
