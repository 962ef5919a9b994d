"""The registered queries of the text operators: thin digests of what the operators return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import fingerprints, language, media, mixing, pieces, pii, quality, similar, token_files, toxicity
from lociflow.llm.common import checkpoint_dir, id_crc, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc(F.col("doc_id")) % 3 == 1
    machine = quality.train(docs, labels, held_out, metadata=("n_chars",))
    got = quality.score(docs, machine, metadata=("n_chars",))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _written(spans) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def _of_kind(spans, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.sanitise(table(spark, sf_dir, "documents"), with_text=False)
    return got.select(
        "doc_id",
        *(_of_kind("base", k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_term"),
    )


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, folder)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode(media.encode(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    got = toxicity.score(docs, toxicity.train(docs, labels, held_out))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses", "asserted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in SQL: sources by rising cap over weight give the level of the others in closed form.
MIXING_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS n,
        [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
    FROM d GROUP BY source
), k AS (
    SELECT *, 1.5::DOUBLE * sum(n) OVER () AS total, sum(w) OVER () AS ws,
        coalesce(sum(2 * n) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
        coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw,
        row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST) AS i
    FROM s
), l AS (
    SELECT coalesce(arg_min((total - caps::DOUBLE) / (ws - cw)::DOUBLE, i) FILTER (WHERE 2.0::DOUBLE * n / w >= (total - caps::DOUBLE) / (ws - cw)::DOUBLE), 0) AS level FROM k
), t AS (
    SELECT source, n, CASE WHEN 2.0::DOUBLE * n / w < level THEN 2.0::DOUBLE * n ELSE w * level END AS target,
        ('0x' || substr(sha256('mix-1' || coalesce(':' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM s, l
), r AS (
    SELECT d.doc_id, d.size, t.n AS source_size, t.target, t.u, CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) AS rank
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
    (least(floor(rate * rank + u) - floor(rate * (rank - 1) + u), 2)::BIGINT * size)::BIGINT AS taken
FROM r
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    got = language.predict(docs, language.train(docs, held_out))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_pieces": op3_pieces,
    "op4_token_files": op4_token_files,
    "op5_fingerprints": op5_fingerprints,
    "op6_similar": op6_similar,
    "op7_media": op7_media,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {"op9_mixing": MIXING_SQL}
