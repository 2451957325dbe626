"""Corpus cleaning pipeline: STAGES run in order, each over what the one before kept.

Every stage takes (spark, docs, sf_dir).  All but the last return rows of ``docs`` with all its columns; the last
returns packed pieces.  Each row is judged and looked up by a key of its own, so rows that repeat an id, or have none, go
only if they are themselves rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import BROADCAST_BYTES, forget, parts, settle, small_batches
from siftline.llm.exact_dedup import exact_dedup
from siftline.llm.mixing import mix
from siftline.llm.near_dedup import near_dedup
from siftline.llm.packing import pack_documents
from siftline.llm.quality_rules import quality_rules


KEY = "pipeline_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, in the order of doc_id with nulls last: doc_id itself where all rows have one of their
    own, else numbers that are written with the rows, so that they stay the same whenever they are read."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if not ids.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).count():
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return settle(dealt.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps; it sees the row's key as doc_id.  Few rejected keys are broadcast; more are
    joined by a shuffle."""
    keyed = _keyed(docs)
    found = judge(keyed.select(F.col(KEY).alias("doc_id"), "text"))
    gone = settle(found.where("NOT kept").select(F.col("doc_id").alias(KEY)), "gone")
    return keyed.join(F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone, KEY, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _kept(docs, quality_rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return _kept(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return _kept(docs, near_dedup)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their copies say, whose expected totals follow the rates."""
    rates = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    times = settle(rates.where("copies <> 1").groupBy(F.col("doc_id").alias("mix_id"), F.col("salt").alias("mix_salt")).agg(F.max("copies").alias("times")), "times")
    times = F.broadcast(times) if times.count() * 28 <= BROADCAST_BYTES else times
    salted = docs.withColumn("row_salt", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    out = salted.join(times, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("row_salt") == F.col("mix_salt")), "left").withColumn("times", F.coalesce("times", F.lit(1)))
    return out.where("times > 0").select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; one row a piece of a document."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _stage(f):
    """``f`` with Arrow batches bounded in the session that it is given, as in the registered queries."""

    @functools.wraps(f)
    def run(spark, docs, sf_dir):
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [(name, _stage(f)) for name, f in (("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing))]
#: Rates come from a fitted classifier and places from a search, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        forget(before)
    return docs
