"""Tokenisation of windows by an injected tokenizer, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stride_tokenizer(sequence: str) -> list[int]:
    """A stand-in without a model: one id for each six bases, at least one."""
    return list(range(max(1, len(sequence) // 6)))


def known_base_tokenizer(sequence: str) -> list[int]:
    """A stand-in whose number of ids depends on the bases: one for each six that are not N, at least one."""
    return list(range(max(1, (len(sequence) - sequence.count("N")) // 6)))


def tokenize(windows: DataFrame, tokenizer: Callable[[str], list[int]], most: int = 512) -> DataFrame:
    """Windows with input_ids, attention_mask, token_count and token_to_base_ratio.

    The task fails on a window of more than `most` tokens and names it.
    """

    @F.pandas_udf("array<int>")
    def ids(sequence: pd.Series) -> pd.Series:
        return sequence.map(tokenizer)

    got = windows.withColumn("input_ids", ids("sequence"))
    return with_counts(got, most)


def with_counts(windows: DataFrame, most: int = 512) -> DataFrame:
    count = F.size("input_ids")
    where = F.concat_ws(" ", F.lit("too many tokens:"), *(F.col(c).cast("string") for c in ("contig", "window_start", "window_end") if c in windows.columns))
    ids = F.when(count <= most, F.col("input_ids")).otherwise(F.raise_error(where))
    return (
        windows.withColumn("input_ids", ids)
        .withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
        .withColumn("token_count", count)
        .withColumn("token_to_base_ratio", count / F.length("sequence"))
    )


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)
