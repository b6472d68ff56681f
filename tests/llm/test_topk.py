import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouchlake.llm import vafile as V

SCHEMA = "vec_id long, embedding array<float>, label int, score double, v int"


def brute(rows, is_query, k=5):
    vectors = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        vectors[i] = min(vectors.get(i, v), v)
    out = set()
    for q, x in vectors.items():
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q and len(y) == len(x))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_ties_and_bad_vectors(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8).round(1)]) for i in range(300)]
    rows += [(400 + k, rows[k][1]) for k in range(40)] + [(5, rows[5][1]), (7, [9.0] * 8), (None, [1.0] * 8), (1000, None), (1001, []), (1002, [1.0])]
    rows += [(2000, [float("nan")] + [0.0] * 7), (2050, [float("inf")] * 8), (2100, [None] + [1.0] * 7), (2150, [1.0, 2.0]), (2200, [0.5, 0.5])]
    table = spark.createDataFrame([(i, e, 1, 0.0, 0) for i, e in rows], SCHEMA)
    got = {tuple(r) for r in V.top_k(table, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_small_and_empty_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 0.0, 0)], SCHEMA)
    assert V.top_k(one, F.col("vec_id") % 50 == 0).count() == 0
    assert V.top_k(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    three = spark.createDataFrame([(k, [1.0 * k, -1.0], 1, 0.0, 0) for k in range(3)], SCHEMA)
    assert {tuple(r) for r in V.top_k(three, F.col("vec_id") % 50 == 0).collect()} == {(0, 1, 1, 65536), (0, 2, 2, 65536)}


def test_bounds_hold():
    rng = np.random.default_rng(0)
    v, q = rng.integers(-200, 200, (50, 12)), rng.integers(-200, 200, (6, 12))
    low = v.min(axis=0)
    width = np.maximum((v.max(axis=0) - low + (1 << V.BITS)) >> V.BITS, 1)
    lower, upper = V.bounds(q, (v - low) // width, low, width)
    exact = q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_many_tiles_and_a_vector_that_a_third_shares(spark, monkeypatch):
    """Tiles of few blocks and query parts; equal vectors don't multiply what is kept; no tile holds more queries than its bound."""
    for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 4), ("GROUP", 2), ("PART_GROUP", 2), ("LEAST_GROUPS", 3), ("FIRST", 6)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 6).round(1)]) for i in range(600)] + [(600 + k, [0.7] * 6) for k in range(300)]
    table = spark.createDataFrame([(i, e, 1, 0.0, 0) for i, e in rows], SCHEMA)
    seen, build = [], V._scan

    def watched(k):
        run = build(k)

        def scan(blocks, parts):
            assert len(blocks) <= 2 * 2 and sum(len(x) for x in parts["query_ids"]) <= 8 * 4 * 2 * 4  # hashing deals unevenly
            return run(blocks, parts)

        seen.append(k)
        return scan

    monkeypatch.setattr(V, "_scan", watched)
    got = {tuple(r) for r in V.top_k(table, F.col("vec_id") % 5 == 0).collect()}
    assert got == brute(rows, lambda i: i % 5 == 0) and seen == [6, 6]
