"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import sys

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from vouchlake.queries import ORACLES, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_small, duck, name):
    df = QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in ORACLES:
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(row[k]) for k in at) for row in found.fetchall()), key=str)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_registry_needs_no_session():
    """Names are listed before any session starts."""
    import subprocess

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)


def test_the_corpus_is_made_in_as_many_tasks_as_its_numbers_need(spark, tmp_path):
    """Keys from one small file are dealt to many tasks before texts are made of them; no key is lost."""
    spark.range(70_000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = QUERIES["corpus_readings"](spark, str(tmp_path)).select("doc_id")
    sizes = [r["n"] for r in made.selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert sum(sizes) == 70_000 and max(sizes) < 25_000
