"""Column functions on variant-effect scores and model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: population labels in class order.
BIOMES = ("Amazon", "Atlantic Forest", "Caatinga", "Cerrado", "Pantanal")


def effect_score(logits: Column, ref_id: Column, alt_id: Column) -> Column:
    """log_softmax(alt) - log_softmax(ref) of 0-based token ids: the normaliser cancels."""
    return F.get(logits, alt_id.cast("int")).cast("double") - F.get(logits, ref_id.cast("int")).cast("double")


def weighted(genotype: Column, score: Column) -> Column:
    """Genotype times the size of the locus's score."""
    return genotype * F.abs(score)


def log_size(score: Column) -> Column:
    return F.log(F.greatest(F.abs(score), F.lit(1e-8)))


def centre_token(spans: Column, centre: int = 256) -> Column:
    """0-based index of the first non-empty (start, end) span that holds the centre; null without."""
    at = F.array_position(F.transform(spans, lambda s: (s["start"] < s["end"]) & (s["start"] <= centre) & (s["end"] > centre)), True)
    return F.when(at > 0, at.cast("int") - 1)


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_index(label: Column, classes: tuple[str, ...] = BIOMES) -> Column:
    """Place of a label among the classes; the row fails on an unknown one."""
    at = F.array_position(F.array(*map(F.lit, classes)), label)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))


def perplexity(loss: Column) -> Column:
    """exp(loss), with losses above 20 cut; NaN stays NaN."""
    return F.when(F.isnan(loss), F.lit(float("nan"))).otherwise(F.exp(F.least(loss, F.lit(20.0))))


def token_accuracy(correct: Column, total: Column) -> Column:
    """correct / total; NaN without tokens."""
    return F.when(total == 0, F.lit(float("nan"))).otherwise(correct / total)
