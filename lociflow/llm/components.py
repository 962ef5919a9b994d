"""Connected components of a link table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import checkpoint


#: Keys over which the rows of one hot root are dealt.
SALTS = 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge can reach.

    Each round takes the least label of the neighbours and then that label's own
    label, so the rounds grow with the logarithm of a chain's length. Labels are
    written to the checkpoint folder; only the number of changes reaches the
    driver. A root of many nodes is looked up under several salted keys. No edges
    give no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = checkpoint(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))
    labels = checkpoint(labels)
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        low = checkpoint(labels.join(near, F.col("node") == F.col("u")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("low")))
        of = low.select(F.col("node").alias("root"), F.col("low").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("root_salt"))
        salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
        jumped = checkpoint(low.withColumn("salt", salt).join(of, (F.col("low") == F.col("root")) & (F.col("salt") == F.col("root_salt"))).select("node", "was", "component"))
        changed = jumped.where("was <> component").count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
