"""Tables derived from others and kept in the shared folder: built once for the files they come from, then opened.

The name of a kept table holds a digest of its inputs' files (path, length, time of change), which Spark lists and folds
into one row; when an input changes, so does the name, and the next call builds anew. A table is written beside and renamed
when whole, so readers never see a part, and of two builders at once one wins and the other's work is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import shared_dir


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def digest(spark: SparkSession, paths: list[str]) -> str:
    """What the files at the paths are, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    n, size, mark = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{n}-{size or 0}-{(mark or 0) & (1 << 64) - 1:016x}"


def once(spark: SparkSession, name: str, paths: list[str], build: Callable[[str], object]) -> str:
    """The place of the kept table of that name over these inputs; build(place) writes it where there is none yet."""
    place = f"{shared_dir(spark)}/kept-{name}-{digest(spark, paths)}"
    files, there = _path(spark, place)
    if files.exists(there):
        return place
    beside = f"{place}-{uuid.uuid4().hex}"
    build(beside)
    _, made = _path(spark, beside)
    if files.exists(there) or not files.rename(made, there):
        files.delete(made, True)
        if not files.exists(there):
            raise RuntimeError(f"{beside} is whole but could not take its place")
    return place


def forget(spark: SparkSession, name: str) -> int:
    """Removes all kept tables of a name; how many there were."""
    files, pattern = _path(spark, f"{shared_dir(spark)}/kept-{name}-*")
    found = files.globStatus(pattern) or []
    for status in found:
        files.delete(status.getPath(), True)
    return len(found)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and survives lost executors."""
    place = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
