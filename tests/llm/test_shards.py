import pytest

from vouchlake.llm.compaction import Conflict, Shard, ShardStore, compacted, plan_merges, tier_of


def test_compaction_keeps_every_row_and_reaches_the_target(spark, sf_medium, odd_docs):
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet")
    sizes = dict(small=30_000, target=400_000, fanout=4)
    store, table = compacted(docs, rows=50, **sizes)
    assert table.exceptAll(docs).count() == docs.exceptAll(table).count() == 0
    shards = store.shards()
    assert sum(s.rows for s in shards) == docs.count() and max(store.versions()) > 1
    assert not plan_merges(shards, **sizes)  # no tier is full
    assert sum(2 * s.size >= 400_000 for s in shards) >= 1
    before = {s.path for s in shards}
    store.append(docs.limit(7), rows=3)
    new = [s for s in store.shards() if s.path not in before]
    assert len(new) >= 2 and sum(s.rows for s in new) == 7 and before <= {s.path for s in store.shards()}
    store, table = compacted(odd_docs, rows=2, small=1, target=1 << 20, fanout=2)
    assert sorted(map(str, table.collect())) == sorted(map(str, odd_docs.collect())) and table.columns == odd_docs.columns


def test_versions_are_atomic(spark, odd_docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    assert store.shards() == [] and store.versions() == []
    store.append(odd_docs)
    base = store.versions()[-1]
    with pytest.raises(Conflict):
        store.commit(base - 1, [])
    assert store.versions() == [base] and sum(s.rows for s in store.shards()) == odd_docs.count()
    odd_docs.write.parquet(f"{store.root}/shards/orphan")  # a writer that died before its commit
    assert sum(s.rows for s in store.shards()) == odd_docs.count()
    assert store.sweep() == 0  # it may be alive
    assert store.sweep(grace=0) > 0 and store.read(odd_docs).count() == odd_docs.count()


def test_empty_arrivals(spark, no_docs):
    store, table = compacted(no_docs)
    assert table.count() == 0 and table.columns == no_docs.columns and store.shards() == []


def test_plans_equal_a_plain_simulation():
    sizes = [1, 1, 1, 1, 2, 9, 9, 9, 9, 9, 40, 41, 42, 43, 500]
    shards = [Shard(f"f{k:02}", s, 1) for k, s in enumerate(sizes)]
    expected, by_tier = [], {}
    for s in sorted(shards, key=lambda s: (s.size, s.path)):
        if 2 * s.size < 400:
            by_tier.setdefault(tier_of(s.size, 4, 4), []).append(s)
    for tier in sorted(by_tier):
        while len(by_tier[tier]) >= 4:
            expected.append([by_tier[tier].pop(0) for _ in range(4)])
    assert plan_merges(shards, 4, 400, 4) == expected
    assert [tier_of(s, 4, 4) for s in (1, 4, 5, 15, 16, 64)] == [0, 0, 1, 1, 2, 3]


def test_sweep_spares_a_writer_between_write_and_commit(spark, odd_docs, tmp_path, monkeypatch):
    one, two = ShardStore(spark, str(tmp_path / "s"), small=1, fanout=2), ShardStore(spark, str(tmp_path / "s"), small=1, fanout=2)
    one.append(odd_docs, 3)
    written = two._written

    def slow(folder):
        found = written(folder)
        one.compact()  # another writer commits and sweeps before this one commits
        one.sweep()
        return found

    monkeypatch.setattr(two, "_written", slow)
    two.append(odd_docs, 5)
    assert sorted(map(str, one.read(odd_docs).collect())) == sorted(2 * list(map(str, odd_docs.collect())))


def test_readers_of_the_version_before_keep_their_files(spark, odd_docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), small=1, fanout=2)
    store.append(odd_docs, 2)
    before = store.read(odd_docs)
    store.compact()
    store.sweep()
    assert sorted(map(str, before.collect())) == sorted(map(str, store.read(odd_docs).collect()))
    assert len(store.versions()) == 2
    store.sweep(grace=0)
    assert len(store.versions()) == 1 and store.read(odd_docs).count() == odd_docs.count()


def test_lost_races(spark, odd_docs, tmp_path, monkeypatch):
    """An append that was not first lands on the newer version; a merge whose inputs are gone is given up, and loses nothing."""
    one, two = ShardStore(spark, str(tmp_path / "s"), small=1, fanout=2), ShardStore(spark, str(tmp_path / "s"), small=1, fanout=2)
    one.append(odd_docs, 2)
    merge, commit, raced = two.merge, two.commit, []

    def beaten(groups):
        made = merge(groups)
        if not raced:
            raced.append(one.compact())
        return made

    monkeypatch.setattr(two, "merge", beaten)
    assert two.compact() and raced == [True]
    assert sorted(map(str, one.read(odd_docs).collect())) == sorted(map(str, odd_docs.collect()))

    def late(base, shards):
        if len(raced) == 1:
            raced.append(one.append(odd_docs, 4))
        return commit(base, shards)

    monkeypatch.setattr(two, "commit", late)
    two.append(odd_docs, 4)
    assert one.read(odd_docs).count() == 3 * odd_docs.count()
