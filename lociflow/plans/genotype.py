"""The variant and genotype pipelines: VCF, reference and metadata to windows, matrix and evaluation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import variants as V
from lociflow.operators import effects, genotypes, guards, loocv, metrics, variants
from lociflow.plans.config import GenotypePlan
from lociflow.sources import fasta, swap, tables, vcf

TILE = 65_536


def finetune_windows(spark: SparkSession, vcf_path: str, fasta_path: str, samples: list[str] | None = None, evidence: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(windows in record order, wanted samples that the VCF lacks). The VCF is read once for all samples; evidence: words that a header of the reference must hold."""
    head = vcf.header(spark, vcf_path)
    wanted = list(head.samples) if samples is None else samples
    absent = [s for s in dict.fromkeys(wanted) if s not in head.samples]
    found = [s for s in dict.fromkeys(wanted) if s in head.samples]
    reference = fasta.scan(spark, fasta_path, strict=False)
    if evidence:
        fasta.require_evidence(reference, evidence)
    if head.contigs:
        named = spark.createDataFrame([(c,) for c in head.contigs], "contig string")
        guards.require_none(guards.unknown_contigs(named, reference), "a header's contig is not in the reference")
    calls = vcf.calls(vcf.records(spark, vcf_path, head), head, found)
    return variants.allele_windows(calls, fasta.tiles(reference, TILE), TILE), absent


def matrix(spark: SparkSession, vcf_path: str, metadata_path: str) -> tuple[DataFrame, DataFrame]:
    """(long genotype matrix with locus keys, metadata of the matched samples)."""
    head = vcf.header(spark, vcf_path)
    known = tables.metadata(spark, metadata_path)
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(head.samples)], "sample_id string, sample_no int")
    matched, _, _ = genotypes.matched_samples(samples, known)
    genotypes.require_samples(matched)
    cells = genotypes.long_matrix(vcf.calls(vcf.records(spark, vcf_path, head, "skip"), head), matched)
    return cells.withColumn("locus_key", F.concat_ws(":", "contig", F.col("pos").cast("string"))), matched


def locus_scores(cells: DataFrame, scores: DataFrame) -> list[float]:
    """Scores (locus_key, score) in the order of dense rows; fails unless each locus has one."""
    loci = cells.select("line_no", "locus_key").distinct()
    s = scores.select(F.col("locus_key").alias("__key"), F.col("score").cast("double").alias("score"))
    guards.require_none(s.groupBy("__key").count().where("count > 1"), "a locus has two scores")
    held = loci.join(s, F.col("locus_key") == F.col("__key"), "left").drop("__key")
    guards.require_none(held.where("score IS NULL"), "a locus has no score")
    return [r.score for r in held.orderBy("line_no").select("score").collect()]


def effect_scores(spark: SparkSession, vcf_path: str, fasta_path: str, scorer: effects.Scorer) -> DataFrame:
    """locus_key, score and failed of each passing SNP: its reference and alternate windows, scored by a model.

    Loci too near a contig's end, or on no contig of the reference, have no
    windows and count as failed, with score 0.
    """
    head = vcf.header(spark, vcf_path)
    records = vcf.records(spark, vcf_path, head, "skip")
    loci = genotypes.loci(variants.passing_snps(records, "skip").where(F.array_contains(F.split("format", ":"), "GT")))
    tiles = fasta.tiles(fasta.scan(spark, fasta_path, strict=False), TILE)
    placed = variants.with_reference(loci, tiles, TILE)
    window = lambda allele: V.centred_window(F.col("bases"), F.col("tile_start"), F.col("pos"), F.col(allele), F.col("contig_length")).alias(f"{allele}_window")
    found = placed.select(F.col("locus_key").alias("__key"), window("ref"), window("alt"))
    return effects.score(loci.select("locus_key").join(found, F.col("locus_key") == F.col("__key"), "left"), scorer)


def evaluate(spark: SparkSession, plan: GenotypePlan, scores: list[float] | None = None, scorer: effects.Scorer | None = None) -> DataFrame:
    """Run the evaluation and store predictions, trials and a summary of the adopted result: the best trial, or the ensemble where better.

    Scores are given in the order of loci, or read from the plan's table, or
    made by a scorer on the plan's reference; a ves_mode other than none fails
    without them. The matrix and scores that are made are kept beside the
    results, for as long as the files they come from stay as they are. The
    ensemble has no trial.
    """
    scored = plan.reference is not None and scorer is not None
    if plan.ves_mode != "none" and scores is None and plan.scores is None and not scored:
        raise ValueError(f"ves_mode {plan.ves_mode} needs scores")
    files = {"vcf": swap.state_of(spark, plan.vcf), "metadata": swap.state_of(spark, plan.metadata)}
    made, matched = matrix(spark, plan.vcf, plan.metadata)
    cells = swap.cached(spark, f"{plan.output}/matrix", files, lambda: made)
    if scores is None and plan.ves_mode != "none":
        if plan.scores:
            table = spark.read.parquet(plan.scores)
        else:
            files = {"vcf": files["vcf"], "reference": swap.state_of(spark, plan.reference)}
            table = swap.cached(spark, f"{plan.output}/scores", files, lambda: effect_scores(spark, plan.vcf, plan.reference, scorer))
        scores = locus_scores(cells, table)
    rows = genotypes.dense_rows(cells).join(matched, "sample_id").select("individual_id", "latitude", "longitude", F.col("biome_population_label").alias("biome"), "genotypes")
    trials = loocv.random_trials(plan.trials, plan.seed, plan.ves_mode) if plan.trials else [loocv.Trial(seed=plan.seed, ves_mode=plan.ves_mode)]
    got = loocv.search(rows, trials, scores=scores, top_k=plan.top_k)
    kept = got["adopted"].first().adopted
    if kept == "ensemble":
        chosen = got["ensemble"].select(F.lit(None).cast("int").alias("trial"), F.col("individual_id").alias("fold"), *got["predictions"].columns[2:])
    else:
        best = got["trials"].orderBy("objective", "trial").limit(1)
        chosen = got["predictions"].join(F.broadcast(best.select("trial")), "trial")
    chosen.write.mode("overwrite").parquet(f"{plan.output}/predictions")
    settings = spark.createDataFrame([(t.trial, json.dumps(x, sort_keys=True)) for t, x in zip(trials, loocv.settings_of(trials))], "trial int, settings string")
    got["trials"].join(settings, "trial").orderBy("objective", "trial").coalesce(1).write.mode("overwrite").json(f"{plan.output}/trials")
    summary = metrics.geo_errors(chosen).crossJoin(metrics.within(chosen)).crossJoin(metrics.accuracy(chosen, "true_biome", "pred_biome")).withColumn("adopted", F.lit(kept))
    summary.coalesce(1).write.mode("overwrite").json(f"{plan.output}/summary")
    return summary
