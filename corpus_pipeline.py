"""A pipeline from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import language, mixing, pieces, pii, similar
from lociflow.llm.common import checkpoint_dir, id_crc, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction of less than this score is no better than a guess.
LEAST_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known, and write it to lang.

    Rejected are those without a letter (null and empty ones too) and those
    whose nearest codeword is hardly nearer than the others. Languages are
    learned from the rows that op10 learns from. If no row has a lang nothing
    can be told, and every document with a letter stays as it is.
    """
    coder = language.train(docs, id_crc(F.col("doc_id")) % 5 == 0)
    if coder is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    got = language.predict(docs, coder, keep=COLUMNS)
    kept = got.where((F.col("lang_pred") != language.UND) & (F.col("score") >= min(LEAST_SCORE, 1.2 / len(coder.langs))))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies.

    Of rows that repeat an id and text one stays; rows that repeat an id with
    other text are documents of their own. Texts without words are copies of
    each other. Rows without an id can't be in a group, and stay.
    """
    first = similar.join(docs).where("first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__first")).distinct()
    rows = docs.select(*COLUMNS).withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__first")), "left_semi").dropDuplicates(["doc_id", "__hash"])
    return kept.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def remove_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that reveal it; n_chars follows the new text where it changed.

    A null text stays null and an empty one empty; rows that repeat an id or
    text, and rows without an id, are treated each by its own text.
    """
    got = pii.sanitise(docs, keep=("doc_id", "lang", "source", "n_chars"))
    changed = F.size("base") + F.size("added") > 0
    return got.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(changed, F.char_length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it.

    The mix is worked out on all rows and told by id; rows that repeat an id all
    take the largest number of its rows, and rows without an id are taken once.
    Null and empty texts have size 0 and are taken at their source's rate.
    """
    docs = docs.select(*COLUMNS)
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0 and doc_id is not null")
    taken = docs.join(copies, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each text, where its pieces end, and the digest of what the ids decode to.

    Repeats stay apart, rows without an id stay, and a null or empty text has no
    ids; an empty table gives an empty one.
    """
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"), decoded=True)


STAGES = [
    ("language", identify),
    ("near_copies", deduplicate),
    ("personal_data", remove_personal),
    ("mixing", mix),
    ("pieces", encode),
]

#: Classifier, MinHash and SentencePiece have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is a table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
