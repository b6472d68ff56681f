import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from vouchlake.llm import turntrie as T

SCHEMA = "conv_id long, turn long, role string, text string, path string, words int"


def rebuild(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = tuple(lender[:h] + t[h:])
    return out


def brute(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    def subtree(p):
        return [p] + [y for c in children[p] for y in subtree(c)]
    out = set()
    for p, m in members.items():
        under = subtree(p)
        saved = sum((len(members[y]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", y[-1][1])) for y in under if y)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[y] for y in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    got = [tuple(r) for r in T.trie(T.sequences(table), **more).collect()]
    want = brute(rebuild(rows))
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    """Few different turns, so that beginnings are shared across shards; copies; conversations that lose all turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), 90):
        for k in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, k if rng.random() < 0.95 else None, rng.choice(["user", None]), rng.choice(["a b", "a  b\nc", "", None, "d"])))
    rows += [(c, k, "user", "same text") for c in range(300, 340) for k in range(4)]
    rows += [(None, 1, "user", "x")] * 3 + [rows[0], rows[0]]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, shard_turns=3)


def test_deep_conversations(spark):
    """Beyond one band, at and around its edges."""
    rows = []
    for c, n in ((1, 63), (2, 64), (3, 65), (5, 128), (6, 129), (7, 200), (8, 200), (41, 64), (42, 130)):
        rows += [(c, k, "user", f"t{k}" if k < 100 + c else f"t{k} {c % 7}") for k in range(n)]
    check(spark, rows)
    check(spark, rows, shard_turns=100)


def test_sorting_equals_python():
    rng = random.Random(3)
    for _ in range(60):
        paths = [tuple(rng.choices([0, 1], k=rng.choice([0, 1, 2, 63, 64, 65, 127, 128, 129]))) for _ in range(30)]
        paths += [p[: rng.randrange(len(p) + 1)] for p in paths] + [tuple([1] * k) for k in (0, 64, 128, 129)]
        convs = np.array(rng.sample(range(1000), len(paths)))
        turns = np.array([len(p) for p in paths])
        order, common = T._sorted(convs, turns, np.array([x for p in paths for x in p], np.int64), np.concatenate([[0], np.cumsum(turns)[:-1]]))
        rows = [(paths[k], convs[k]) for k in order]
        assert rows == sorted(rows)
        for a, b, n in zip(rows, rows[1:], common[1:]):
            assert a[0][:n] == b[0][:n] and (a[0][: n + 1] != b[0][: n + 1] or n in (len(a[0]), len(b[0])))


def test_a_beginning_that_all_share_is_spread(spark):
    """No shard holds much more than its part, though all begin alike and half are copies."""
    rows = [(c * 20, k, "user", "hello" if k < 3 else f"{c % 2 * c}") for c in range(4000) for k in range(4)]
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    paths = T.sequences(table, rebuild=False)
    sizes = [n for n in paths.repartitionByRange(16, "path", "conv_id").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
    assert max(sizes) < 4 * 4000 / 16
    got = {tuple(r) for r in T.trie(paths, shard_turns=1000).collect()}
    convs = {c * 20: (("user", "hello"),) * 3 + (("user", str(c % 2 * c)),) for c in range(4000)}
    assert got == brute(convs)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.trie(T.sequences(empty)).count() == 0
    c = next(k for k in range(1, 20) if zlib.crc32(str(k).encode()) % 4 >= 1)
    check(spark, [(c, 0, "user", "lost")])
    check(spark, [(5, 1, "user", "word " * 300_000)])


def test_query_equals_brute_force_and_its_sql(spark, sf_medium):
    import __spark_entry__ as E

    got = [tuple(r) for r in E.queries()["op11_trie"](spark, sf_medium).select(*T.RESULT).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_medium}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert set(got) == brute(rebuild(rows)) and len(got) == len(set(got))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_medium}/conversations.parquet'")
    assert sorted(got, key=str) == sorted(db.sql(f"SELECT {', '.join(T.RESULT)} FROM ({E.oracle_sql()['op11_trie']})").fetchall(), key=str)
