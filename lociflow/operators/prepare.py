"""Preparation of sequence records: normalise, judge, split into retained and rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import sequence as S
from lociflow.operators.guards import require_sources
from lociflow.plans.contracts import Preprocessing


def judged(sequences: DataFrame, config: Preprocessing) -> DataFrame:
    """Sequences normalised, with fractions and the reason of rejection (null: retained).

    A null sequence counts as empty. Normalisation is bound once and generated
    as one row, since a filter on what follows from it would otherwise be pushed
    below and normalise again.
    """

    def judge(s):
        amb = S.ambiguity_fraction(s)
        reason = F.when(F.length(s) < config.min_sequence_length, "short_sequence").when(amb > config.max_ambiguity_fraction, "high_ambiguity")
        return F.struct(s.alias("sequence"), S.gc_fraction(s).alias("gc_fraction"), amb.alias("ambiguity_fraction"), reason.alias("reason"))

    normal = S.checked(S.normalize(F.coalesce("sequence", F.lit("")), config.ambiguity_mode, config.alphabet), config.alphabet)
    others = [c for c in sequences.columns if c not in ("sequence", "gc_fraction", "ambiguity_fraction", "reason")]
    return sequences.select(*others, F.inline(F.transform(F.array(normal), judge)))


def prepare(sequences: DataFrame, config: Preprocessing, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(retained, rejected). Source labels are checked first, by an action, so that no filter hides a bad one."""
    if check:
        require_sources(sequences)
    all_ = judged(sequences, config)
    retained = all_.where("reason IS NULL").drop("reason")
    rejected = all_.where("reason IS NOT NULL").select("sample_id", "individual_id", "contig", "source", "reason", F.length("sequence").alias("sequence_length"), "ambiguity_fraction")
    return retained, rejected


def report(retained: DataFrame) -> DataFrame:
    """Mean fractions of the retained sequences, 0 without any."""
    return retained.agg(F.count("*").alias("retained"), F.coalesce(F.avg("gc_fraction"), F.lit(0.0)).alias("mean_gc_fraction"), F.coalesce(F.avg("ambiguity_fraction"), F.lit(0.0)).alias("mean_ambiguity_fraction"))
