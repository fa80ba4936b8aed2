"""Tables written on the way: Parquet in the shared folder of spark.checkpoint.dir, which cuts lineage and survives lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, one of our own if driver and
    executors are one process; on a cluster that would be a folder of each machine, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loglake-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/loglake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_open: list[list[str]] = []  # the tables of each temporaries() that is open


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() writes inside are deleted at the end, when what was made of them has been written."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written; the tables written on the way are deleted."""
    with temporaries(spark):
        out = materialise(make(), name)
        path = _open[-1].pop()
    if _open:
        _open[-1].append(path)
    return out
