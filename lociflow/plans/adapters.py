"""Views of the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import sequence as S
from lociflow.operators.shared import spread
from lociflow.plans.contracts import Preprocessing

#: Geometry for documents: short enough for most of them to hold windows.
CONFIG = Preprocessing(min_sequence_length=200, max_ambiguity_fraction=0.8, window_size=64, window_stride=48, locus_block_size=1024)
#: Genotypes by l_linenumber % 8.
GENOTYPES = ("0/0", "0/1", "1|1", "./.", "1/1", "0|1", "1/0", "0/0")
TILE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequence records, unsupported characters dropped; documents of a source share a contig."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    kept = F.regexp_replace(S.normalize(F.col("text")), "[^ACGTN]", "")
    return d.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("individual_id"), F.col("source").alias("contig"), kept.alias("sequence"), F.lit("reference").alias("source"), F.lit(0).cast("long").alias("sequence_start"))


def with_document(spark: SparkSession, sf_dir: str, l: DataFrame, name: str) -> DataFrame:
    """Line items with a document's id under a name: the order key modulo the number of documents."""
    n = table(spark, sf_dir, "documents").agg(F.greatest(F.count("*"), F.lit(1)).alias("__ids"))
    l = l.crossJoin(F.broadcast(n))  # one row
    return l.withColumn(name, (F.col("l_orderkey") % F.col("__ids")).cast("string")).drop("__ids")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mask spans of documents."""
    l = with_document(spark, sf_dir, table(spark, sf_dir, "lineitem"), "sample_id")
    kind = F.when(F.col("l_returnflag") == "A", "filtered").when(F.col("l_returnflag") == "N", "no_call").otherwise("other")
    start = F.col("l_linenumber").cast("long") * 40
    return l.select("sample_id", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), kind.alias("category"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as variant calls, one for each part, supplier and flag."""
    l = table(spark, sf_dir, "lineitem")
    gt = F.element_at(F.array(*map(F.lit, GENOTYPES)), (F.col("l_linenumber") + F.col("l_suppkey").cast("int")) % 8 + 1)
    rows = l.groupBy(F.col("l_returnflag").alias("contig"), F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("supp")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_linestatus", "l_suppkey")).alias("m"))
    rows = rows.select("contig", "pos", "supp", F.col("m.l_linenumber").alias("l_linenumber"), F.col("m.l_suppkey").alias("l_suppkey"), F.col("m.l_linestatus").alias("status"))
    alt = F.element_at(F.array(*map(F.lit, ("T", "C", "G", "AT", "T,G", "."))), (F.col("pos") % 6 + 1).cast("int"))
    return rows.select(
        "contig", "pos", F.lit("A").alias("ref"), alt.alias("alt"), F.when(F.col("status") == "O", "PASS").when(F.col("pos") % 7 == 0, "LowQual").otherwise(".").alias("filter"),
        F.lit("GT:DP").alias("format"), F.concat(gt, F.lit(":9")).alias("field"), F.col("supp").cast("string").alias("sample_id"), F.col("pos").alias("line_no"),
    )


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as individuals; the region is the biome, coordinates are formulas of keys."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    return j.select(k.cast("string").alias("sample_id"), k.cast("string").alias("individual_id"), F.col("r_name").alias("biome"), (F.col("n_nationkey") * 1.5 - 30 + (k % 10) * 0.1).alias("latitude"), (F.col("n_nationkey") * 0.7 - 60 + (k % 7) * 0.2).alias("longitude"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits of a token position: score by two of their places."""
    from lociflow.functions.scores import effect_score

    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("locus_idx"), effect_score(F.col("embedding"), F.col("vec_id") % 64, (F.col("vec_id") * 7 + 3) % 64).alias("score"))


def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits of ten classes, with their label."""
    from lociflow.functions.scores import argmax

    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id"), F.col("label").cast("int").alias("label"), argmax(F.slice("embedding", 1, 10)).alias("predicted"))


def trial_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as predictions of six trials for each vector."""
    e = table(spark, sf_dir, "embeddings")
    t = F.explode(F.sequence(F.lit(0), F.lit(5)))
    x = e.select(F.col("vec_id").alias("individual_id"), "embedding", t.alias("trial"))
    at = lambda k: F.get("embedding", (F.col("trial") * 10 + k).cast("int")).cast("double")
    vote = F.when(at(0) > 0.1, "a").when(at(1) > 0, "b").otherwise("c")
    return x.select("individual_id", "trial", F.col("trial").alias("trial_rank"), vote.alias("pred_biome"), (at(2) * 10).alias("pred_lat"), (at(3) * 10).alias("pred_lon"), F.array(at(4), at(5), at(6)).alias("logits"))
