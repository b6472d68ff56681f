"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vouchlake.sources.bindings import bound, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *reads: str, sql: str | None = None):
    """Registers a function of the DataFrames in `reads` (bindings or driver tables) under `name`."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(bound(spark, sf_dir, r) for r in reads))
        if sql is not None:
            ORACLES[name] = with_bindings(sql, *reads)
        return f

    return add


def files_query(name: str, sql: str | None = None):
    """Registers a function of (session, folder of the tables) under `name`, for jobs that read the files themselves."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return add


def mod97(c: str) -> str:
    """DuckDB: whether c is two letters, then digits alone, with the right check digits."""
    swapped = f"substr({c}, 5) || (ascii({c}) - 55) || (ascii(substr({c}, 2, 1)) - 55) || substr({c}, 3, 2)"
    return f"(CASE WHEN regexp_matches({c}, '^[A-Z]{{2}}[0-9]{{10,30}}$') THEN CAST({swapped} AS HUGEINT) % 97 = 1 ELSE FALSE END)"
