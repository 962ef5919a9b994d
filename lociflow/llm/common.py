"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.sources.swap import qualified

#: Texts of one Arrow batch are handled in runs of about this many characters.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: Column) -> Column:
    """Unsigned crc32 of an id written as text."""
    return F.crc32(col.cast("string").cast("binary"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir with its scheme; a folder of its own only where none is set, in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lociflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return qualified(spark, found)


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and cut from its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, read back: later stages read only the columns they need."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; a null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def runs(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of whole texts with about `most` characters each, so that memory stays bounded."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def map_texts(df: DataFrame, fn: Callable[[list, list[str]], dict], schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Map whole texts in Arrow batches.

    fn(kept, texts) gets the kept columns as lists and the texts of a run and
    returns a dict of lists by the schema's names, kept columns aside.
    """
    cols = list(keep)
    out_schema = _arrow(df, cols, schema)
    kept_ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def go(batches):
        for b in batches:
            texts = texts_of(b, "__text")
            kept = [b.column(c) for c in cols]
            for r in runs(texts):
                got = fn([k[r.start : r.stop] for k in kept], texts[r])
                arrays = [k[r.start : r.stop] for k in kept] + [pa.array(got[f.name], type=f.type) for f in list(out_schema)[len(cols) :]]
                yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return df.select(*cols, F.col(text).alias("__text")).mapInArrow(go, ", ".join(x for x in (kept_ddl, schema) if x))


def _arrow(df: DataFrame, cols: list[str], ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType([df.schema[c] for c in cols] + list(StructType.fromDDL(ddl)))) if ddl else to_arrow_schema(StructType([df.schema[c] for c in cols]))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes above 0x20) of UTF-8 bytes, in order."""
    word = data > 0x20
    if not word.any():
        return np.empty(0, np.uint64)
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = _powers(int((ends - starts).max()))
    at = np.arange(len(data), dtype=np.int64)
    at -= np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(data)))])
    at[~word] = 0
    values = np.where(word, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers[at]
    return mix(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[1], np.full(max(n, 1024) - 1, 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
    return _POWERS


_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; fewer words than n make one run, none make none."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = words[:m].copy()
    for i in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m])
    return h


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, label, text and also) of at most per_class rows of each label outside the held-out rows.

    The rows with the smallest hash of their id are taken, so reruns agree.
    Ids that carry both labels are left out; of rows that repeat an id the one
    of the least hash is taken. The ids have a fixed bound, 2 * per_class, and
    so are broadcast to the one scan of the texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("__most"))
    known = known.where("label = __most").select("doc_id", "label")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text", *also).join(F.broadcast(picked), "doc_id")
    row = F.min_by(F.struct("text", *also), F.xxhash64("text", *also)).alias("__row")
    return found.groupBy("doc_id", "label").agg(row).select("doc_id", "label", "__row.*")


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse rows: indices and values of all rows, and where each row begins."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.idx = np.concatenate([r[0] for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
        self.val = np.concatenate([r[1] for r in rows]).astype(np.float32) if rows else np.empty(0, np.float32)
        self.ptr = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int64)

    def take(self, which: np.ndarray) -> Rows:
        return Rows([(self.idx[self.ptr[i] : self.ptr[i + 1]], self.val[self.ptr[i] : self.ptr[i + 1]]) for i in which])
