"""Sample tables, sidecars, and checks of downloaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.guards import require_columns, require_none

#: Fixed value: columns that sample metadata must have.
REQUIRED = ("sample_id", "individual_id", "biome_population_label", "latitude", "longitude")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata with numeric coordinates; of rows with one sample_id the last stays, and extra columns are kept."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    require_columns(raw, REQUIRED)
    rows = raw.withColumn("sample_id", F.btrim("sample_id")).where(F.col("sample_id") != "").withColumn("__order", F.monotonically_increasing_id())
    rows = rows.groupBy("sample_id").agg(*(F.max_by(c, "__order").alias(c) for c in raw.columns if c != "sample_id"))
    for c in ("latitude", "longitude"):
        require_none(rows.where(F.col(c).try_cast("double").isNull()).select("sample_id", c), f"{c} is not a number")
    return rows.select(*(F.col(c).cast("double").alias(c) if c in ("latitude", "longitude") else c for c in raw.columns))


def sample_list(spark: SparkSession, path: str) -> list[str]:
    """Sample ids in file order, blanks dropped, duplicates kept; a list of samples is small."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    require_columns(raw, ("sample_id",))
    return [r[0].strip() for r in raw.select("sample_id").collect() if r[0] and r[0].strip()]


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def verify(spark: SparkSession, files: dict[str, tuple[str, str | None, int | None]]) -> DataFrame:
    """path, size and whether checksum (md5 or sha256, by its length) and size hold, of files on hand.

    files: path to (kind, checksum, size). Nothing is downloaded.
    """
    from lociflow.operators.guards import ContractError

    if not files:
        raise ContractError("no files to verify")
    got = spark.read.format("binaryFile").load(list(files)).select("path", F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    want = spark.createDataFrame([(p, c, s) for p, (_, c, s) in files.items()], "want_path string, checksum string, want_size long")
    joined = want.join(got, F.expr("endswith(path, want_path)"), "left")
    ok = (F.col("checksum").isNull() | (F.lower("checksum") == F.when(F.length("checksum") == 32, F.col("md5")).otherwise(F.col("sha256")))) & (F.col("want_size").isNull() | (F.col("want_size") == F.col("size"))) & F.col("path").isNotNull()
    return joined.select(F.col("want_path").alias("path"), "size", F.coalesce(ok, F.lit(False)).alias("verified"))
