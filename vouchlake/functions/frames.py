"""Helpers on whole DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(docs: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with what f makes of each document, without a join: the row rides along as f's doc_id.

    f takes documents and returns one row a document with its doc_id. Its columns replace
    those of the same name.
    """
    keyed = docs.withColumn("doc_id", F.struct(*docs.columns))
    got = f(keyed)
    new = [c for c in got.columns if c != "doc_id"]
    return got.select(*(F.col(f"doc_id.{c}").alias(c) for c in docs.columns if c not in new), *new)


def spread(rows: DataFrame, key: str, each: int = 20_000) -> DataFrame:
    """rows dealt by `key` to a task for every `each` of them, the session's parallelism at least: a small file of keys that much is derived from would be one task otherwise."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(parts, key)
