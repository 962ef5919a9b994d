"""The tokenised corpus: partitioned Parquet, its manifest, tar shards and JSON lines."""

from __future__ import annotations

import io
import json
import tarfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators.guards import ContractError, mixed_tokenizers, require_columns, require_none
from lociflow.operators.shared import settled
from lociflow.plans.contracts import Export, Tokenizer
from lociflow.sources import swap

ORDER = ("locus_id", "contig", "block_start", "window_start", "sample_id", "source")


def exported(tokens: DataFrame, contract: Export, tokenizer: Tokenizer, keep_sequence: bool | None = None) -> DataFrame:
    """Rows as the corpus holds them: ids, counts, and structs of window and tokenizer; mask counters stay behind."""
    keep = ["ambiguity_fraction", "gc_fraction", "individual_id", "sample_id", "split", "source"]
    if contract.keep_coordinates:
        keep += ["block_start", "block_end", "contig", "locus_id", "window_start", "window_end"]
    if contract.keep_sequence if keep_sequence is None else keep_sequence:
        keep.append("sequence")
    if contract.keep_hash:
        keep.append("sequence_hash")
    t = F.struct(F.lit(tokenizer.identifier).alias("identifier"), F.lit(tokenizer.revision).alias("revision"), F.lit(tokenizer.max_tokens).alias("max_tokens"), F.lit(tokenizer.trust_remote_code).alias("trust_remote_code"))
    block = F.concat_ws("-", F.col("block_start").cast("string"), F.col("block_end").cast("string"))
    return tokens.select("input_ids", "attention_mask", "token_count", "token_to_base_ratio", t.alias("tokenizer"), F.struct(*keep).alias("window"), "split", "contig", block.alias("block_id"), *(F.col(c).alias(f"__{c}") for c in ORDER))


def write(rows: DataFrame, path: str, contract: Export, manifest: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Write exported rows under Hive-style folders, with the manifest and metadata.json, and put the whole in place at once.

    Rows are rebalanced by the partition keys, so that a task writes few folders
    and a long contig goes to several tasks, and sorted within files by the
    corpus order; a file has at most row_group_size rows. All is written beside
    the target and renamed when whole: after a failure the target is as it was.
    mode is errorifexists or overwrite.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be 'errorifexists' or 'overwrite'")
    if contract.format != "parquet":
        raise ValueError("write_shards writes the webdataset format")
    require_none(mixed_tokenizers(rows.select("tokenizer")), "rows of several tokenizers")
    spark = rows.sparkSession
    swap.recover(spark, path)
    if mode == "errorifexists" and swap.exists(spark, path):
        raise ContractError(f"{path} is there already")
    with swap.replaced(spark, path) as new:
        keys = list(contract.partition_keys)
        out = rows.hint("rebalance", *keys).sortWithinPartitions(*keys, *(f"__{c}" for c in ORDER))
        drop = [f"__{c}" for c in ORDER] + [c for c in ("split", "contig", "block_id") if c not in keys]
        out.drop(*drop).write.mode("errorifexists").option("maxRecordsPerFile", contract.row_group_size).partitionBy(*keys).parquet(f"{new}/data")
        if manifest is not None:
            manifest.orderBy("contig", "block_start", "split").write.json(f"{new}/split_manifest")
        data = spark.read.parquet(f"{new}/data")
        inside = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.*)$", 1)  # a URI: a plus is itself, not a blank
        name = F.concat(F.lit("data/"), F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))))
        files = data.groupBy(name.alias("file"), F.col("window.split").alias("split")).agg(F.count("*").alias("record_count"))
        files.orderBy("split", "file").write.json(f"{new}/files")
        tokenizer = data.select("tokenizer").limit(1).collect()
        _head(spark, new, contract, "files", manifest is not None, tokenizer[0][0].asDict() if tokenizer else None)


def _head(spark: SparkSession, path: str, contract: Export, files: str, split_manifest: bool, tokenizer: dict | None) -> None:
    """metadata.json with sorted keys: the contract, the tokenizer, and counts by split; files and loci, which grow with the data, are tables beside it that it names."""
    listed = spark.read.schema("file string, split string, record_count long").json(f"{path}/{files}")
    splits = {r[0]: {"record_count": r[1], "files": r[2]} for r in listed.groupBy("split").agg(F.sum("record_count"), F.count("*")).collect()}
    head = {
        "deterministic_partition_keys": list(contract.partition_keys), "export_format": contract.format, "files": files, "preserve_coordinates": contract.keep_coordinates,
        "preserve_raw_windows": contract.keep_sequence, "preserve_sequence_hashes": contract.keep_hash, "row_group_size": contract.row_group_size, "sequence_hash_algorithm": "sha256",
        "split_manifest": "split_manifest" if split_manifest else None, "splits": splits, "tokenizer": tokenizer,
    }
    swap.write_text(spark, f"{path}/metadata.json", json.dumps(head, indent=2, sort_keys=True) + "\n")


def head(spark: SparkSession, path: str) -> dict:
    """What metadata.json says; a folder without it is not whole."""
    if not swap.exists(spark, f"{path}/metadata.json"):
        raise ContractError(f"{path} has no manifest")
    return json.loads(swap.read_text(spark, f"{path}/metadata.json"))


def read(spark: SparkSession, path: str, split: str | None = None, max_tokens: int | None = None, columns: tuple[str, ...] = ("input_ids", "attention_mask")) -> DataFrame:
    """Ids and masks of the corpus, cut to max_tokens, from the files that the manifest lists.

    Stray files in the folder are not read; split leaves out the files of
    others, and no other column is read. The list of files is what Spark's own
    index would hold on the driver.
    """
    listed = spark.read.schema("file string, split string").json(f"{path}/{head(spark, path)['files']}")
    files = [f"{path}/{r.file}" for r in (listed.where(F.col("split") == split) if split is not None else listed).select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], ", ".join(f"{c} array<int>" for c in columns))
    data = spark.read.option("basePath", f"{path}/data").parquet(*files)
    require_columns(data, columns)
    if split is not None:
        data = data.where(F.col("window.split") == split)  # a file holds several where split is no partition key
    return data.select(*(F.slice(c, 1, max_tokens).alias(c) if max_tokens else F.col(c) for c in columns))


def numbered(rows: DataFrame, order: list, by: tuple[str, ...] = (), name: str = "number") -> DataFrame:
    """Rows with their place in an order, from 0, over all or within each value of `by`, whose columns lead the order.

    Rows are ranged by the order; counts of the ranges give each its first
    number, so no task gets all rows or a whole value. The order is settled by a
    checkpoint before it is ranged, so that what makes the rows runs once.
    """
    ranged = settled(settled(rows).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    keys = [F.col(c) for c in by]
    parts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    # a row for each range and value
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), before.alias("__before"))
    on = F.col("__part") == F.col("__p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    here = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    joined = ranged.withColumn("__here", here).join(parts, on)
    return joined.withColumn(name, (F.col("__before") + F.col("__here") - 1).cast("long")).drop("__part", "__p", "__before", "__here", *(f"__{c}" for c in by))


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int, workers: int = 1) -> DataFrame:
    """Rows with their position in an order that seed and epoch fix, and the worker who reads each, dealt in turn.

    The whole table is shuffled, so no buffer bounds how far a row may move.
    """
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
    got = numbered(rows.withColumn("__rank", rank), [F.col("__rank"), F.col(key)], name="position").drop("__rank")
    return got.withColumn("worker", F.col("position") % workers)


def shard_numbers(windows: DataFrame, shard_size: int) -> DataFrame:
    """Rows with shard and member numbers: by split, in corpus order, shard_size to a shard."""
    order = [F.col(c) for c in ("split", "contig", "block_start", "window_start", "sample_id", "source")]
    got = numbered(windows, order, by=("split",), name="__number")
    return got.withColumn("shard", F.floor(F.col("__number") / shard_size)).withColumn("member", F.col("__number") % shard_size).drop("__number")


def write_tar_shards(rows: DataFrame, folder: str, shard_size: int) -> DataFrame:
    """Tar files `{split}-{shard:05d}.tar` with members `{number:08d}.json`; returns shard, members and size.

    rows: split, shard, member and the JSON text `record`. The folder must be one
    that executors share, on any file system that pyarrow opens. Tar headers hold
    no time or owner, so equal rows make equal files; a file is renamed when
    whole.
    """
    schema = pa.schema([("split", pa.string()), ("shard", pa.int64()), ("members", pa.int64()), ("size", pa.int64())])
    target = swap.qualified(rows.sparkSession, folder)

    def go(batches):
        where, base = fs.FileSystem.from_uri(target)
        where.create_dir(base, recursive=True)
        now, tar, raw, n, own = None, None, None, 0, None

        def close():
            tar.close()
            size = raw.tell()
            raw.close()
            where.move(own, f"{base}/{now[0]}-{now[1]:05d}.tar")
            return pa.RecordBatch.from_pydict({"split": [now[0]], "shard": [now[1]], "members": [n], "size": [size]}, schema=schema)

        for b in batches:
            for r in b.to_pylist():
                if (r["split"], r["shard"]) != now:
                    if now:
                        yield close()
                    now, n = (r["split"], r["shard"]), 0
                    own = f"{base}/.{now[0]}-{now[1]:05d}.{uuid.uuid4().hex}"
                    raw = where.open_output_stream(own)
                    tar = tarfile.open(fileobj=raw, mode="w|", format=tarfile.USTAR_FORMAT)
                data = r["record"].encode()
                info = tarfile.TarInfo(f"{r['shard'] * shard_size + r['member']:08d}.json")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                n += 1
        if now:
            yield close()

    sorted_rows = rows.select("split", "shard", "member", "record").repartition("split", "shard").sortWithinPartitions("split", "shard", "member")
    return sorted_rows.mapInArrow(go, "split string, shard long, members long, size long")


def write_shards(rows: DataFrame, path: str, contract: Export, manifest: DataFrame | None = None) -> None:
    """Exported rows (with raw windows) as tar shards of row_group_size members, with metadata.json, put in place at once."""
    require_none(mixed_tokenizers(rows.select("tokenizer")), "rows of several tokenizers")
    spark = rows.sparkSession
    swap.recover(spark, path)
    order = [F.col(f"__{c}").alias(c) for c in ORDER if c not in ("locus_id", "contig")]
    record = F.to_json(F.struct("input_ids", "attention_mask", "token_count", "token_to_base_ratio", "tokenizer", "window"))
    flat = rows.select("split", "contig", *order, record.alias("record"))
    with swap.replaced(spark, path) as new:
        made = write_tar_shards(shard_numbers(flat, contract.row_group_size), f"{new}/data", contract.row_group_size)
        listed = made.select(F.format_string("data/%s-%05d.tar", "split", "shard").alias("file"), "split", F.col("members").alias("record_count"))
        listed.write.json(f"{new}/files")
        if manifest is not None:
            manifest.orderBy("contig", "block_start", "split").write.json(f"{new}/split_manifest")
        tokenizer = rows.select("tokenizer").limit(1).collect()
        _head(spark, new, contract, "files", manifest is not None, tokenizer[0][0].asDict() if tokenizer else None)


def write_json_lines(windows: DataFrame, path: str, order: tuple[str, ...] = ("line_no", "allele_no")) -> None:
    """Windows as JSON lines in record order; a failed job leaves no output."""
    windows.orderBy(*order).drop(*order).write.mode("errorifexists").json(path)
