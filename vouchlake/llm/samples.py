"""Bounded, repeatable samples of rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import bounded_batches


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, mod `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def learnable(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """The rows whose texts may be learnt from."""
    return docs.where(remainder(F.col("doc_id"), modulus) != held_out)


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_positive: int, max_unlabelled: int
) -> DataFrame:
    """Rows text, is_positive to fit on; at most max_positive + max_unlabelled of them.

    Positives: up to `max_positive` documents with label 1; label 0 is never read.
    Unlabelled: up to `max_unlabelled` documents of any kind. Those with the smallest hash
    of id and text are taken, so the choice is even and repeatable. Rows with equal id and
    text count once, so no id, however often it comes, takes more than the bounds allow. Held-out
    ids give neither labels nor text, null ids neither. A document labelled twice is
    positive if any label is 1. What is broadcast is the chosen keys, two numbers each.
    """
    rows = learnable(docs, modulus, held_out).where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text", F.lit(label)))
    keys = keyed.select("doc_id", "key")
    known = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    first = lambda df, n: df.select("key").distinct().orderBy("key").limit(n)
    chosen = (
        first(keys.join(known, "doc_id", "left_semi"), max_positive).withColumn("is_positive", F.lit(True))
        .unionByName(first(keys, max_unlabelled).withColumn("is_positive", F.lit(False)))
    )
    return keyed.join(F.broadcast(chosen), "key").groupBy("key", "is_positive").agg(F.min("text").alias("text")).select("text", "is_positive")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
