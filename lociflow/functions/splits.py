"""Split assignment by hash: the same block goes to the same split on every run and machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the corpus contract.
SPLIT_WEIGHTS = (("train", 0.8), ("validation", 0.2))
SPLIT_SEED = "feline-locus-split-v1"


def locus_id(contig: Column, block_start: Column, block_end: Column) -> Column:
    return F.concat(contig, F.lit(":"), block_start.cast("string"), F.lit("-"), block_end.cast("string"))


def hash_position(seed: str, key: Column) -> Column:
    """First 64 bits of sha256("seed:key") as a number in [0, 1); by decimal, since they overflow a long."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10)
    return bits.cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def assign_split(locus: Column, weights: tuple[tuple[str, float], ...] = SPLIT_WEIGHTS, seed: str = SPLIT_SEED) -> Column:
    """The first split whose cumulative share exceeds the position; the last if rounding leaves none."""
    at, total, low = hash_position(seed, locus), sum(w for _, w in weights), 0.0
    out = None
    for name, w in weights:
        low += w / total
        out = F.when(at < low, name) if out is None else out.when(at < low, name)
    return out.otherwise(weights[-1][0])
