import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from vouchlake.llm import spelling as S


def near(a, b):
    """Whether one insertion, deletion or replacement turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(words):
    forms, out = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
        out[w] = len(others)
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {(w, forms[w], root(w), n, out[w], words.get(forms[w])) for w, n in words.items()}


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = {}
    while len(words) < 250:
        w = "".join(rng.choices("abÿ", k=rng.randrange(6, 9)))
        words[w] = rng.choice([5, 5, 6, 25, 26, 125, 130, 625, 4000])
    got = rows_of(S.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(got) == len(words) and set(got) == brute(words)
    assert any(r[2] not in (r[0], r[1]) for r in got)


def test_long_words_and_both_sides_of_the_bound(spark, monkeypatch):
    rng = random.Random(7)
    words = {}
    for size in (63, 64, 65, 66, 200):
        base = "".join(rng.choices("ab", k=size))
        words[base] = 100
        for _ in range(12):
            k = rng.randrange(size)
            words[rng.choice([base[:k] + base[k + 1 :], base[:k] + "c" + base[k:], base[:k] + "c" + base[k + 1 :], base[:k] + base[k] + base[k:]])] = rng.choice([5, 19, 20, 21, 500])
    words |= {"a" * n: c for n, c in ((60, 5), (64, 30), (65, 200), (66, 200), (67, 5))}
    got = rows_of(S.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(got) == len(words) and set(got) == brute(words)


def test_a_run_of_a_hundred_thousand_letters(spark):
    words = {"ab" * 50_000: 10, "ab" * 50_000 + "c": 50, "z" * 100_000: 5}
    got = {(r[0][:3], len(r[0]), r[4], len(r[1] or "")) for r in rows_of(S.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got == {("aba", 100_000, 1, 100_001), ("aba", 100_001, 1, 0), ("zzz", 100_000, 0, 0)}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] * 5
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    words = brute_words(rows)
    assert {(r.word, r.n) for r in S.count_words(docs).collect()} == set(words.items())
    assert set(rows_of(S.group_variants(S.count_words(docs)))) == brute(words)
    assert S.group_variants(S.count_words(no_docs)).count() == 0


def test_query_equals_brute_force_and_its_sql(spark, sf_small):
    import __spark_entry__ as E

    got = rows_of(E.queries()["op13_variants"](spark, sf_small))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    words = brute_words(rows)
    assert {(r[0], r[3]) for r in got} == set(words.items())
    few = dict(sorted(words.items())[:1500])
    by_word = {r[0]: r for r in got}
    for w, n in few.items():
        others = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        assert by_word[w][4] == len(others)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    assert sorted(got, key=str) == sorted(db.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({E.oracle_sql()['op13_variants']})").fetchall(), key=str)
