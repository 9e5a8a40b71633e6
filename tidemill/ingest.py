"""Full-refresh sink with verification, and an incremental loader on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def verify(loaded: DataFrame, made: DataFrame) -> None:
    """Raises unless both hold as many rows and documents."""
    count = lambda df: tuple(df.agg(F.count("*"), F.countDistinct("doc_id")).first())
    if count(loaded) != count(made):
        raise RuntimeError("the loaded table does not hold what was made")


def full_refresh(made: DataFrame, path: str) -> DataFrame:
    """Replaces the table at path, partitioned by document type, by chunks (doc_id, chunk_index, ...), and verifies it.

    The id is made of document and chunk and not a running number, so no task has to see all rows. The new table is
    written beside the old one and made once, so an embedder sees each chunk once; what the writing tasks counted must be
    what is read again, and only then does the new table take the place of the old one, by two renames: the old one is put
    aside, whole, and deleted last. A failure before leaves it untouched; between the renames readers find no table.
    """
    spark = made.sparkSession
    rows = made.withColumn("id", F.xxhash64("doc_id", "chunk_index"))
    typed = "metadata" in rows.columns
    seen = Observation()
    rows = rows.observe(seen, F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("missing"))
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    if typed:
        rows.withColumn("doc_type", F.col("metadata.doc_type")).write.partitionBy("doc_type").parquet(beside)
    else:
        rows.write.parquet(beside)
    written = spark.read.parquet(beside)
    if tuple(written.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()) != (seen.get["n"], seen.get["missing"]):
        raise RuntimeError("the loaded table does not hold what was made")
    of = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{beside}-old"
    had = files.exists(of(path))
    if had and not files.rename(of(path), of(aside)):
        raise RuntimeError(f"{path} could not be put aside for {beside}, which is whole")
    if not files.rename(of(beside), of(path)):
        if had:
            files.rename(of(aside), of(path))
        raise RuntimeError(f"{beside} is whole but could not take its place")
    files.delete(of(aside), True)
    return spark.read.parquet(path)


def embed(made: DataFrame, embedder: Callable[[list[str]], list[list[float]]], width: int, batch: int = 16) -> DataFrame:
    """made with embedding from a callable that takes up to batch texts; another width than promised is an error."""
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(texts), batch):
            found = embedder(texts.iloc[k : k + batch].tolist())
            if any(len(v) != width for v in found):
                raise ValueError("the embedder gave another width")
            out += found
        return pd.Series(out)

    return made.withColumn("embedding", vectors("content"))


def hashed_frequencies(width: int) -> Callable[[list[str]], list[list[float]]]:
    """An embedder without a model: hashed word counts of unit length."""
    import zlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % width] += 1
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return run


def incremental(spark: SparkSession, incoming: str, kinds: str, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Chunks new Parquet files of documents as they come; ends when all present files are done.

    Each micro-batch owns the folder load=<its number> of the table, so one that is retried replaces what it left.
    """

    def add(batch: DataFrame, number: int) -> None:
        make(batch).withColumn("id", F.xxhash64("doc_id", "chunk_index")).write.mode("overwrite").parquet(f"{path}/load={number}")

    stream = spark.readStream.schema(kinds).parquet(incoming)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
