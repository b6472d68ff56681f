import random
import re
from collections import Counter, defaultdict

from vouchlake.llm.components import components
from vouchlake.llm.neardup import CHUNKS, LEAST_BLOCKS, THRESHOLD, WIDTH, in_blocks, keep_first, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def shingle_set(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    take = min(words, len(found))
    return frozenset(tuple(found[k : k + take]) for k in range(len(found) - take + 1))


def brute(rows, words=4):
    """doc_id -> (set size, smallest id reachable), by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t, words) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, s in sets.items():
        for j, shared in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * shared >= 80 * (len(s) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                above[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(seed, size, mutations):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(mutations)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force_on_documents(spark, sf_medium):
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet")
    for words in (4, 5):
        expected = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], words)
        for r in near_duplicates(docs, words).collect():
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_equals_brute_force_on_families_of_near_copies(spark):
    """Large groups in which many pairs lie just under or over the threshold, and chains that hubs miss."""
    texts = family(1, 260, 14) + family(2, 60, 40) + family(3, 5, 3)
    walk = ("a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2).split()
    for k in range(12):  # a chain: each near the next only
        walk[4 * k % 52] = f"step{k}"
        texts.append(" ".join(walk))
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    expected = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_hot_keys_give_the_same(spark, monkeypatch):
    """Every key hot, every hub in parts, many blocks: the paths for very large groups, on a family with unlinked near copies."""
    from vouchlake.llm import components as K
    from vouchlake.llm import neardup as N

    for module, name, value in ((K, "HOT", 3), (N, "HUB_PAIRS", 7), (N, "BLOCK", 40), (K, "CHUNK", 50)):
        monkeypatch.setattr(module, name, value)
    texts = family(11, 150, 45) + family(12, 40, 8)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[3]) for k in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_near_copies_without_ids(spark):
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:99], "other"])
    rows = [(None, " ".join(base)), (None, near), (None, near), (5, "quite another text of several words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.component for r in near_duplicates(docs).collect() if r.doc_id is None}) == 1
    kept = keep_first(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "None"]


def test_rows_of_the_last_step_grow_in_proportion(spark):
    """A family of m unlinked near copies costs LEAST_BLOCKS rows a member."""
    for m in (2000, 4000, 8000):
        sized = spark.range(m).selectExpr("id AS node", "id AS label", "0L AS cluster", "300L AS n")
        rows = in_blocks(sized, m)
        assert rows.count() == LEAST_BLOCKS * m
        assert rows.groupBy("i", "j").count().agg({"count": "max"}).first()[0] < 2.3 * m / LEAST_BLOCKS + 200
        meet = rows.alias("x").join(rows.alias("y"), ["i", "j"]).where("x.node < y.node") if m == 2000 else None
        if meet is not None:
            assert meet.selectExpr("x.node AS a", "y.node AS b").distinct().count() == m * (m - 1) // 2


def test_odd_rows(odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].component_id == by_id[2].component_id == 1 and by_id[1].kept and not by_id[2].kept
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id in (3, 4, 5)] == [(0, 3), (0, 4), (0, 5)]
    assert by_id[7].n_shingles == 1 and by_id[8].component_id == 7
    assert by_id[None].component_id is None and by_id[None].kept
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "4", "5", "6", "7", "9", "None"]
    assert near_duplicates(no_docs).count() == 0 and keep_first(no_docs).count() == 0


def test_pigeonhole_holds():
    """Any THRESHOLD differences leave some chunk with at most one."""
    assert THRESHOLD < 2 * CHUNKS <= THRESHOLD + 1 and WIDTH > 1


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 7), (900, 900), (-3, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: -3 for k in (-3, *range(100, 161))} | {k: 5 for k in (5, 7, *range(300, 340))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tasks_leave_little_in_their_worker():
    """A worker keeps what a stage left in it while the pipeline's later stages run; what is made of a batch comes in slices."""
    import pyarrow as pa

    from vouchlake.llm import neardup as N
    from vouchlake.llm.workspace import worker_cache

    texts = [f"words of text {k} that come once" for k in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts, "text_hash": list(range(1000))})
    described = pa.Table.from_batches(N._describe(4)(iter([batch])))
    assert described.num_rows == 1000 and not worker_cache("word-hashes", dict)
    wanted = pa.RecordBatch.from_pydict({"node": list(range(1000)), "set_id": described["set_id"].to_pylist(), "text": texts})
    made = list(N._sets_of(4)(iter([wanted])))
    assert sum(b.num_rows for b in made) == 1000 and max(b.num_rows for b in made) <= 256
    assert not worker_cache("word-hashes", dict)


def test_plans_nest_no_joins_of_others(spark, monkeypatch):
    """The driver holds each plan many times over while it runs; those of hundreds of nodes filled its memory."""
    from vouchlake.llm import components as K
    from vouchlake.llm import neardup as N
    from vouchlake.llm.workspace import cut

    nodes = []

    def counted(df):
        nodes.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return cut(df)

    for module in (K, N):
        monkeypatch.setattr(module, "cut", counted)
    monkeypatch.setattr(K, "CHUNK", 50)  # so that components takes its steps
    rows = list(enumerate(family(11, 150, 45) + family(12, 40, 8)))
    found = counted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows)
    assert max(nodes) <= 80, sorted(nodes)[-9:]


def test_components_in_one_task_and_in_many(spark, monkeypatch):
    """What one task contracts at once takes no steps; with more edges the steps give the same."""
    from vouchlake.llm import components as K

    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)]
    above = {}

    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    expected = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    table = spark.createDataFrame(edges, "a long, b long").repartition(6)
    with monkeypatch.context() as m:
        m.setattr(K, "CHUNK", 20)
        got = components(table).collect()
        assert len(got) == len(expected) and {r.node: r.root for r in got} == expected
    monkeypatch.setattr(K, "join_one", None)
    got = components(table).collect()
    assert len(got) == len(expected) and {r.node: r.root for r in got} == expected
