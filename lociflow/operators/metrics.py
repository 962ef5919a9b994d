"""Metrics of geographic assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.geo import haversine_km

THRESHOLDS_KM = (250, 500, 1000)


def lower_median(column: str) -> Column:
    """The lower of two middle values, as an aggregate."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)")


def coordinate_stats(metadata: DataFrame) -> DataFrame:
    """Mean and sample deviation of the individuals' mean coordinates; deviations of at least 1e-6."""
    each = metadata.groupBy("individual_id").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    sd = lambda c: F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(1e-6))
    return each.agg(F.avg("lat").alias("lat_mean"), sd("lat").alias("lat_std"), F.avg("lon").alias("lon_mean"), sd("lon").alias("lon_std"))


def with_distance(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("haversine_km", haversine_km(F.col("true_lat"), F.col("true_lon"), F.col("pred_lat"), F.col("pred_lon")))


def geo_errors(predictions: DataFrame) -> DataFrame:
    """Mean absolute errors, mean and lower median distance; NaN without predictions."""
    nan = F.lit(float("nan"))
    return predictions.agg(
        F.coalesce(F.avg(F.abs(F.col("pred_lat") - F.col("true_lat"))), nan).alias("mae_lat_deg"),
        F.coalesce(F.avg(F.abs(F.col("pred_lon") - F.col("true_lon"))), nan).alias("mae_lon_deg"),
        F.coalesce(F.avg("haversine_km"), nan).alias("haversine_km_mean"),
        F.coalesce(lower_median("haversine_km"), nan).alias("haversine_km_median"),
    )


def within(predictions: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS_KM) -> DataFrame:
    """Share of predictions within each distance, limits included."""
    return predictions.agg(*(F.avg(F.when(F.col("haversine_km") <= t, 1.0).otherwise(0.0)).alias(f"within_{t}km") for t in thresholds))


def by_class(predictions: DataFrame, label: str = "true_biome", predicted: str = "pred_biome") -> DataFrame:
    """Lower median and mean distance, and accuracy, of each true class."""
    return predictions.groupBy(label).agg(F.count("*").alias("n"), lower_median("haversine_km").alias("median_km"), F.avg("haversine_km").alias("mean_km"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def class_scores(pairs: DataFrame, classes: list, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of every class, those that never occur included; 0 where a denominator is 0."""
    spark = pairs.sparkSession
    kind = pairs.schema[label].dataType.simpleString()
    names = spark.createDataFrame([(c,) for c in classes], f"class {kind}")
    cells = pairs.groupBy(label, predicted).agg(F.count("*").alias("n"))
    one = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    near = names.join(cells, (F.col("class") == F.col(label)) | (F.col("class") == F.col(predicted)), "left")
    counts = near.groupBy("class").agg(
        one((F.col(label) == F.col("class")) & (F.col(predicted) == F.col("class"))).alias("tp"),
        one((F.col(label) != F.col("class")) & (F.col(predicted) == F.col("class"))).alias("fp"),
        one((F.col(label) == F.col("class")) & (F.col(predicted) != F.col("class"))).alias("fn"),
    )
    p = F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def macro_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f1").alias("macro_f1"))


def accuracy(pairs: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return pairs.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def histogram(predictions: DataFrame, predicted: str = "predicted") -> DataFrame:
    return predictions.groupBy(predicted).agg(F.count("*").alias("n"))
