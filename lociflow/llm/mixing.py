"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target
over size. The expected copies are prefix-summed over the source's documents by
falling size, one random offset in [0, 1) is added, and a document is emitted
once for each integer that its interval crosses. Neighbours in the order have
about equal sizes, so the words taken stay within about one document of the
target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.common import checkpoint

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> list[float]:
    """Targets of sources given in order: shares by weight, none above most * size.

    Sources whose cap lies below the common level keep their cap and leave the
    excess to the others, by weight; the level is (total - caps) / weights left.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total = share * sum(s for _, s in sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i][1] / w[i])
    caps, left = 0, sum(w)
    level = total / left if left else 0.0
    for i in order:
        if most * sizes[i][1] / w[i] >= level:
            break
        caps, left = caps + most * sizes[i][1], left - w[i]
        level = (total - caps) / left if left else 0.0
    return [float(most * s) if most * s / v < level else v * level for (_, s), v in zip(sizes, w)]


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, 1), from a hash of seed and source."""
    text = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), source)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row.

    A null text has size 0; documents of size 0 have copies like others of
    their source, but a source of only such documents takes none. A null source
    is a source of its own, the last. Rows that repeat an id count each; an
    empty table gives an empty table. Only the sizes of sources reach the
    driver: sources are names that someone weighs, not a key that grows with
    the rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    order = [F.col("source").asc_nulls_last(), F.desc("size"), F.col("doc_id").asc_nulls_last()]
    # the thin rows are written first, so that words are counted once and not again to find the ranges
    rows = checkpoint(checkpoint(rows).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    found = targets([(r[0], r[1]) for r in sizes], weights, share, most)
    plan = spark.createDataFrame([(s, n, t) for (s, n), t in zip(sizes, found)], "source string, source_size long, target double")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    parts = parts.alias("p").join(plan.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "part", "before", "source_size", "target")
    here = Window.partitionBy("source", "part").orderBy(*order[1:])
    ranked = rows.withColumn("rank", F.row_number().over(here)).alias("r")
    joined = ranked.join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
    rank = F.col("rank") + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("r.source"), seed)
    copies = F.least(F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u), F.lit(most)).cast("long")
    return joined.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", copies.alias("copies"))
