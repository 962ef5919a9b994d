"""Best trials and their ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators.metrics import lower_median


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of the least objective; the earlier one of equals."""
    return trials.agg(F.min_by("trial", F.struct("objective", "trial")).alias("trial"), F.min("objective").alias("objective"))


def top_trials(trials: DataFrame, k: int = 5) -> DataFrame:
    return trials.orderBy("objective", "trial").limit(k)


def mean_coordinates(predictions: DataFrame, by: str = "individual_id") -> DataFrame:
    return predictions.groupBy(by).agg(F.avg("pred_lat").alias("pred_lat"), F.avg("pred_lon").alias("pred_lon"))


def mean_logits(predictions: DataFrame, by: str = "individual_id") -> DataFrame:
    """Means of logits by place."""
    each = predictions.select(by, F.posexplode("logits").alias("k", "v")).groupBy(by, "k").agg(F.avg("v").alias("v"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("logits"))


def majority_vote(predictions: DataFrame, by: str = "individual_id", vote: str = "pred_biome", rank: str = "trial_rank") -> DataFrame:
    """The class most trials predict; of equals the one a better trial predicts first."""
    counts = predictions.groupBy(by, vote).agg(F.count("*").alias("votes"), F.min(rank).alias("first_rank"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("votes"), "first_rank"))
    return counts.withColumn("__place", place).where("__place = 1").select(by, vote, "votes")


def ensemble(predictions: DataFrame, trials: DataFrame, k: int = 5) -> DataFrame:
    """Mean coordinates, mean logits and majority vote of the k best trials."""
    ranked = top_trials(trials, k).withColumn("trial_rank", F.row_number().over(Window.orderBy("objective", "trial")))  # k rows
    chosen = predictions.join(F.broadcast(ranked.select("trial", "trial_rank")), "trial")
    return mean_coordinates(chosen).join(mean_logits(chosen), "individual_id").join(majority_vote(chosen), "individual_id")


def adopted(ensemble_km: DataFrame, best_km: DataFrame) -> DataFrame:
    """Which result stays: the ensemble only if its lower median distance is less."""
    e = ensemble_km.agg(lower_median("haversine_km").alias("ensemble_median"))
    b = best_km.agg(lower_median("haversine_km").alias("best_median"))
    return e.crossJoin(b).withColumn("adopted", F.when(F.col("ensemble_median") < F.col("best_median"), "ensemble").otherwise("best_trial"))
