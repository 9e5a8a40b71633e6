"""A corpus pipeline over the documents table: language ID, near-dedup, secret removal, mixing, tokenizing.

Every stage is a function of (spark, docs, sf_dir) over all rows its predecessor kept; run() writes each result as Parquet
to the shared folder and reads it again for the next stage. All stages but the last return the columns of documents.

Nulls, empty texts, ties, repeated rows, empty tables and further columns are handled as the operators define; further
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, documents
from tidemill.llm.language_id import fit, identify
from tidemill.llm.minhash_dedup import near_duplicates
from tidemill.llm.mixing import mix
from tidemill.llm.secret_scan import redact
from tidemill.llm.sentencepiece_codec import encoded_and_checked

#: The part of its share of n-grams by which the best language must lead the second one to be believed.
LEAST_LEAD = 0.02
#: Near copies share this many words in a row, in this part of all their shingles.
SHINGLE, THRESHOLD = 5, (4, 5)

#: Bytes of a piece of a shard of the mix: a mix is 3/2 of its input, over 8 shards.
PIECE = 5 * (1 << 26)

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage: Callable) -> Callable:
    """Gives further columns names of no meaning while a stage runs, so none can clash with what it makes."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: f"_further_{k}" for k, c in enumerate(docs.columns) if c not in OWN}
        out = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in hidden.items()})

    return run_stage


@shielded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language the filters know; und and undecided ones go. A missing lang is filled in."""
    found = identify(docs, fit(docs), lead=True).where((F.col("lang_pred") != "und") & (F.col("lead") >= LEAST_LEAD))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score", "lead")


@shielded
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near copies, one row of it; documents without words are no copies.

    Null ids are kept unless they are linked; rows of one id go or stay together, equal texts of one id are one row.
    """
    kept = near_duplicates(docs, SHINGLE, THRESHOLD).where("kept").select(F.struct("doc_id").alias("_id")).distinct()
    chosen = docs.withColumn("_id", F.struct("doc_id")).join(kept, "_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("_id", "text").orderBy("source", "lang", "n_chars"))
    return chosen.withColumn("_place", place).where("_place = 1").select(*docs.columns)


@shielded
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and replaces every secret in their texts by a mark; n_chars follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


@shielded
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their target words; rows lie in shards in shuffled order.

    A shard is dealt over pieces of about PIECE bytes, so tasks grow in number and not in size.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    mixed = mix(docs)
    return mixed.repartition("mix_shard", F.pmod("mix_order", F.lit(max(64, size // PIECE)))).sortWithinPartitions("mix_shard", "mix_order").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_chars, ids, n_ids, exact: the token ids, and whether they decode to the text."""
    out = encoded_and_checked(docs, ("doc_id", "source", "lang", "n_chars"))
    return out.select("doc_id", "source", "lang", "n_chars", "ids", F.size("ids").cast("long").alias("n_ids"), "exact")


STAGES = [
    ("language_id", language_stage),
    ("minhash_dedup", dedup_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Language ID, near-dedup and tokenizing can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
