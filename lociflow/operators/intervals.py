"""Windows and intervals: overlaps, union lengths, source-aware masked counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.functions import sequence as S

#: Categories that have columns of their own.
FILTERED, NO_CALL = "filtered", "no_call"


def clipped(spans: Column, start: Column, end: Column) -> Column:
    """Spans cut to [start, end); those that don't overlap go."""
    cut = F.transform(spans, lambda s: F.struct(F.greatest(s["start"], start).alias("start"), F.least(s["end"], end).alias("end"), s["category"].alias("category")))
    return F.filter(cut, lambda s: s["end"] > s["start"])


def union_length(spans: Column) -> Column:
    """Bases that at least one span covers: a sweep over spans by start."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("reach"))
    step = lambda a, s: F.struct(
        (a["total"] + F.when(a["reach"].isNull() | (s["start"] >= a["reach"]), s["end"] - s["start"]).otherwise(F.greatest(F.lit(0).cast("long"), s["end"] - a["reach"]))).cast("long").alias("total"),
        F.greatest(a["reach"], s["end"]).cast("long").alias("reach"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["total"])


def category_bases(spans: Column, category: Column | None) -> Column:
    """Bases of a category's spans (null: of all but filtered and no_call); overlaps of spans count each."""
    of = (lambda s: s["category"] == category) if category is not None else (lambda s: ~s["category"].isin(FILTERED, NO_CALL))
    return F.aggregate(F.filter(spans, of), F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def source_aware(source: Column, covered: Column, sequence: Column) -> Column:
    """consensus reports spans alone; reference falls back to the N that its sequence holds."""
    return F.when(source == "consensus", covered).otherwise(F.greatest(covered, S.masked_bases(sequence)))


def with_masks(windows: DataFrame, spans: str = "mask_spans") -> DataFrame:
    """Windows with their mask counters, from spans that each row carries; no shuffle."""
    w = windows.withColumn(spans, clipped(F.col(spans), F.col("window_start"), F.col("window_end")))
    counts = F.array_sort(F.transform(F.array_distinct(F.transform(spans, lambda s: s["category"])), lambda c: F.struct(c.alias("category"), F.aggregate(F.filter(spans, lambda s: s["category"] == c), F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])).alias("bases"))))
    return (
        w.withColumn("unique_masked_bases", source_aware(F.col("source"), union_length(F.col(spans)), F.col("sequence")))
        .withColumn("filtered_bases", category_bases(F.col(spans), F.lit(FILTERED)))
        .withColumn("no_call_bases", category_bases(F.col(spans), F.lit(NO_CALL)))
        .withColumn("other_masked_bases", category_bases(F.col(spans), None))
        .withColumn("masked_base_counts", counts)
        .drop(spans)
    )


def overlap_join(windows: DataFrame, spans: DataFrame, keys: list[str], bin_size: int, how: str = "left") -> DataFrame:
    """Windows with the spans that overlap them, joined on keys and bins.

    windows: keys, window_start, window_end; spans: keys, start, end, category.
    Each window has one bin, that of its start; a span goes to the bins from one
    before its start to its end, so windows may be up to bin_size long. cut_start and
    cut_end are null for a window without spans: greatest and least skip nulls,
    so the cut is taken only where there is a span.
    """
    w = windows.withColumn("__bin", F.floor(F.col("window_start") / bin_size))
    first, last = F.floor(F.col("start") / bin_size) - 1, F.floor((F.col("end") - 1) / bin_size)
    s = spans.where(F.col("end") > F.col("start")).withColumn("__bin", F.explode(F.sequence(first, last))).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bin").alias("__span_bin"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), "category")
    on = (F.col("__bin") == F.col("__span_bin")) & (F.col("span_start") < F.col("window_end")) & (F.col("span_end") > F.col("window_start"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    joined = w.join(s, on, how).drop("__bin", "__span_bin", *(f"__{k}" for k in keys))
    inside = F.col("span_start").isNotNull()
    return joined.withColumn("cut_start", F.when(inside, F.greatest("span_start", "window_start"))).withColumn("cut_end", F.when(inside, F.least("span_end", "window_end"))).drop("span_start", "span_end")


def union_lengths(overlaps: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Bases that at least one span covers, for each window: what each span adds beyond those before it; keep: columns that a window's rows share."""
    before = Window.partitionBy(*by).orderBy("cut_start", "cut_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("cut_end").over(before)
    adds = F.greatest(F.lit(0), F.col("cut_end") - F.greatest("cut_start", F.coalesce(reach, F.col("cut_start"))))
    return overlaps.withColumn("__adds", F.when(F.col("cut_start").isNotNull(), adds).otherwise(0)).groupBy(*by).agg(F.sum("__adds").cast("long").alias("covered_bases"), *(F.first(k).alias(k) for k in keep))


def category_sums(overlaps: DataFrame, by: list[str]) -> DataFrame:
    """Bases of filtered, no_call and other spans, for each window."""
    size = F.coalesce(F.col("cut_end") - F.col("cut_start"), F.lit(0))
    of = lambda test: F.sum(F.when(test, size).otherwise(0)).cast("long")
    return overlaps.groupBy(*by).agg(
        of(F.col("category") == FILTERED).alias("filtered_bases"),
        of(F.col("category") == NO_CALL).alias("no_call_bases"),
        of(F.col("category").isNotNull() & ~F.col("category").isin(FILTERED, NO_CALL)).alias("other_masked_bases"),
    )
