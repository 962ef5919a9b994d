"""Variant-effect scores: scoring by an injected model, statistics, selection, gate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.scores import log_size

Scorer = Callable[[list[str], list[str]], np.ndarray]


def score(windows: DataFrame, scorer: Scorer, batch: int = 128) -> DataFrame:
    """locus_key, score and failed of (locus_key, ref_window, alt_window), in batches.

    The scorer returns a number for each pair. A pair without windows, or in a
    batch on which the scorer fails even alone, scores 0 and is counted as failed.
    """
    schema = pa.schema([("locus_key", pa.string()), ("score", pa.float64()), ("failed", pa.bool_())])

    def of(refs, alts):
        try:
            return [(float(x), False) for x in scorer(refs, alts)]
        except Exception:
            if len(refs) == 1:
                return [(0.0, True)]
            return [p for r, a in zip(refs, alts) for p in of([r], [a])]

    def go(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                keys, refs, alts = (part.column(c).to_pylist() for c in ("locus_key", "ref_window", "alt_window"))
                good = [k for k in range(len(keys)) if refs[k] is not None and alts[k] is not None]
                got = dict(zip(good, of([refs[k] for k in good], [alts[k] for k in good]))) if good else {}
                rows = [got.get(k, (0.0, True)) for k in range(len(keys))]
                yield pa.RecordBatch.from_pydict({"locus_key": keys, "score": [r[0] for r in rows], "failed": [r[1] for r in rows]}, schema=schema)

    return windows.select("locus_key", "ref_window", "alt_window").mapInArrow(go, "locus_key string, score double, failed boolean")


def stats(scores: DataFrame) -> DataFrame:
    """Counts, mean, population deviation and range of the scores."""
    failed = F.col("failed") if "failed" in scores.columns else F.lit(False)
    return scores.agg(F.count_if(~failed).alias("scored"), F.count_if(failed).alias("failed"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("min"), F.max("score").alias("max"))


def top(scores: DataFrame, k: int, locus: str = "locus_idx") -> DataFrame:
    """The k loci of the largest scores by size, ties by locus, in locus order."""
    return scores.orderBy(F.abs("score").desc(), F.col(locus)).limit(max(0, k)).orderBy(locus)


def gate_init(scores: DataFrame, locus: str = "locus_idx") -> DataFrame:
    """Gate logits: 2 times the standardised log size of each score; one row of statistics is joined."""
    logs = scores.withColumn("__l", log_size(F.col("score")))
    one = logs.agg(F.avg("__l").alias("__mean"), F.greatest(F.coalesce(F.stddev_samp("__l"), F.lit(0.0)), F.lit(1e-6)).alias("__sd"))
    return logs.crossJoin(F.broadcast(one)).select(locus, ((F.col("__l") - F.col("__mean")) / F.col("__sd") * 2).alias("gate"))
