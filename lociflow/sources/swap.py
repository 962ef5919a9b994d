"""Whole folders put in place at once, on any file system that Hadoop knows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path, parent) of a path; one without a scheme is on the default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    where = fs.makeQualified(where)
    return fs, where, where.getParent()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as a URI that other readers open too."""
    found = _at(spark, path)[1].toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _at(spark, path)
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, from the driver."""
    fs, where, _ = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"could not rename {a} to {b}")


@contextmanager
def replaced(spark: SparkSession, target: str) -> Iterator[str]:
    """A new folder to fill, which takes the target's place when the block ends without an error.

    What stood there is moved aside first and deleted last; if the second rename
    fails it is moved back. After an error the target is as it was.
    """
    fs, where, parent = _at(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    run = uuid.uuid4().hex
    new, old = path(parent, f".tmp_{where.getName()}_{run}"), path(parent, f".old_{where.getName()}_{run}")
    try:
        yield qualified(spark, new.toString())
        if fs.exists(where):
            _rename(fs, where, old)
            try:
                _rename(fs, new, where)
            except BaseException:
                _rename(fs, old, where)
                raise
            fs.delete(old, True)
        else:
            _rename(fs, new, where)
    finally:
        fs.delete(new, True)


def recover(spark: SparkSession, target: str) -> bool:
    """Put the newest folder that was moved aside back where a crash left no target."""
    fs, where, parent = _at(spark, target)
    if fs.exists(where) or not fs.exists(parent):
        return False
    left = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(parent, f".old_{where.getName()}_*"))
    if not left:
        return False
    _rename(fs, max(left, key=lambda s: s.getModificationTime()).getPath(), where)
    return True


def state_of(spark: SparkSession, path: str) -> list:
    """Address, length and time of change of a file: what a table made from it depends on."""
    fs, where, _ = _at(spark, path)
    status = fs.getFileStatus(where)
    return [where.toString(), status.getLen(), status.getModificationTime()]


def cached(spark: SparkSession, path: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at a path, made anew where what it depends on (its key) has changed."""
    recover(spark, path)
    if not exists(spark, f"{path}/key.json") or json.loads(read_text(spark, f"{path}/key.json")) != key:
        with replaced(spark, path) as new:
            make().write.parquet(f"{new}/data")
            write_text(spark, f"{new}/key.json", json.dumps(key, sort_keys=True))
    return spark.read.parquet(f"{path}/data")
