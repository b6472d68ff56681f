import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouchlake.llm import packing
from vouchlake.llm.tokenout import best_fit_decreasing, read_files, token_matrices, width_of, write_files
from vouchlake.llm.tokens import ByteBpe, vocabulary_bytes, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_ids_equal_the_library(library, odd_docs):
    bpe = ByteBpe(vocabulary_bytes())
    for r in odd_docs.select("text").collect():
        assert bpe.encode(r.text).tolist() == library.encode(r.text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 3_000_000 + "x", "\n" * 10**6 + "x", "a" + "\u3000" * 400_000, " " * 10**6 + "<|endoftext|>" + "\t" * 10**6, "z" * 10**6], ids=len)
def test_long_runs_of_one_mark(library, text):
    assert ByteBpe(vocabulary_bytes()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ten_million_marks():
    assert len(ByteBpe(vocabulary_bytes()).encode(" " * 10**7)) == 10**7  # no two spaces are one token


def test_short_runs_cut_the_same_way(library, monkeypatch):
    """The rule for long runs, applied to runs of three marks already."""
    import random
    import re

    from vouchlake.llm import tokens

    monkeypatch.setattr(tokens, "_LONG_RUN", re.compile(tokens._LONG_RUN.pattern.replace(f"{{{tokens.LONG_RUN},}}", "{3,}")))
    bpe, rng = ByteBpe(vocabulary_bytes()), random.Random(5)
    marks = "\t\n\x0b\x0c\r \x85\xa0\u2003\u2028\u202f\u3000\x1c\x1f\u200b"
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B1", "!", " ", "'s", "é", "中", rng.choice(marks) * rng.randint(1, 6)]) for _ in range(rng.randint(0, 12)))
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_wide_numbers():
    assert width_of(1 << 16) == np.dtype("<u2") and width_of((1 << 16) + 1) == np.dtype("<u4")


def test_windows_over_65536(spark, library):
    text = "one two three " * 50_000
    row = token_matrices(spark.createDataFrame([(1, text)], "doc_id long, text string"), window=200_000).first()
    ids = library.encode(text, add_special_tokens=False).ids + [50256]
    assert np.frombuffer(row.position_ids, "<u4")[: len(ids)].tolist() == list(range(len(ids)))
    assert np.frombuffer(row.input_ids, "<u2")[: len(ids)].tolist() == ids


def test_binary_files_give_back_the_rows(spark, odd_docs, no_docs, tmp_path):
    made = token_matrices(odd_docs.repartition(3), window=64, rows=16)
    manifest = write_files(made, str(tmp_path / "out"))
    assert sum(p["rows"] for p in manifest["parts"]) == made.count()
    key = lambda df: sorted((bytes(r.input_ids), bytes(r.position_ids), tuple(r.cu_seqlens)) for r in df.collect())
    assert key(read_files(spark, str(tmp_path / "out"))) == key(made)
    (tmp_path / "out" / "stray.input_ids").write_bytes(b"an attempt that was lost")
    assert read_files(spark, str(tmp_path / "out")).count() == made.count()
    write_files(token_matrices(no_docs), str(tmp_path / "none"))
    assert read_files(spark, str(tmp_path / "none")).count() == 0
    spoilt = tmp_path / "out" / f"{manifest['parts'][0]['part']}.input_ids"
    spoilt.write_bytes(bytes(reversed(spoilt.read_bytes())))
    with pytest.raises(Exception, match="altered"):
        read_files(spark, str(tmp_path / "out")).count()


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(200):
        window = int(rng.integers(3, 40))
        lengths = rng.integers(1, window + 1, rng.integers(0, 60))
        got, bins = best_fit_decreasing(lengths, window)
        rooms: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(window - n)
        used = np.bincount(got, lengths, minlength=bins).astype(int)
        assert bins == len(rooms) and sorted(window - used) == sorted(rooms)


def test_matrices_give_back_every_id(odd_docs, no_docs, library):
    window = 64
    rows = token_matrices(odd_docs, window=window, rows=16).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    found: dict = {}
    for r in rows:
        ids, at = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == window and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= window
        assert not ids[r.n_tokens :].any()
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            assert at[a:b].tolist() == list(range(b - a))
            found.setdefault((doc, start), []).append(ids[a:b].tolist())
    for r in {(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()}:
        whole = library.encode(r[1] or "", add_special_tokens=False).ids + [50256]
        got = [found[r[0], s][0] for s in range(0, len(whole), window)]
        assert sum(got, []) == whole
    assert len(found[2, 0]) == 2  # the repeated row is there twice
    assert token_matrices(no_docs).count() == 0


def check_pieces(rows, expected, window):
    """Pieces tile documents and sequences; digests are those of the ids."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    for doc, ids, times in expected:
        mine = sorted(by_doc.pop(doc), key=lambda r: r.start)
        starts = list(range(0, len(ids), window))
        assert [r.start for r in mine] == [s for s in starts for _ in range(times)]
        for r in mine:
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) and r.doc_tokens == len(ids)
    assert not by_doc
    return len(by_sequence), sum(len(ids) * n for _, ids, n in expected)


def test_pack_documents(spark, sf_medium, library):
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    expected = [(i, library.encode(t, add_special_tokens=False).ids + [0], 1) for i, t in texts.items()]
    sequences, tokens = check_pieces(packing.pack(docs).collect(), expected, 1024)
    assert sequences * 1024 <= 1.01 * tokens


def test_pack_odd_rows(odd_docs, no_docs, library):
    texts = {(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()}
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids + [0], 2 if i == 2 else 1) for i, t in texts]
    check_pieces(packing.pack(odd_docs).collect(), expected, 1024)
    assert packing.pack(no_docs).count() == 0


def test_equal_rows_are_dealt_to_many_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "the same text")] * 3000, "doc_id long, text string")
    kept = {}
    monkeypatch.setattr(packing, "cut", lambda df: kept.setdefault("pieces", df))
    packing.pack(docs)
    dealt = kept["pieces"].select((F.col("dealt") % 64).alias("bucket"))
    assert dealt.groupBy("bucket").count().agg({"count": "max"}).first()[0] < 100


def test_packed_sequences_hold_the_ids(odd_docs, library):
    rows = packing.pack(odd_docs).collect()
    assert all(len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    texts = {r.text: r.doc_id for r in odd_docs.collect()}
    for text, doc in texts.items():
        pieces = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.doc_id == doc}
        assert sum((pieces[s] for s in sorted(pieces)), []) == library.encode(text or "", add_special_tokens=False).ids + [0]


def test_least_squares_reaches_the_plain_optimum():
    rng = np.random.default_rng(3)
    window = 12
    counts = np.append(0, rng.integers(0, 50, window))
    parts = packing.combinations(window, np.flatnonzero(counts))
    assert all(p.sum() == window for p in parts)
    matrix = np.stack([np.bincount(p[p > 0], minlength=window + 1) for p in parts], axis=1).astype(float)
    target = counts.astype(float)
    x = packing.solve_nnls(parts, counts, 5000)
    gradient = matrix.T @ (matrix @ x - target)
    assert (x >= 0).all() and (gradient > -1e-3).all() and np.abs(gradient * x).max() < 0.05  # the optimality conditions


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(4)
    for window in (7, 64, 1024):
        counts = np.append(0, rng.integers(0, 30, window) * (rng.random(window) < 0.5))
        plan = packing.plan_windows(counts, window)
        length = np.repeat(np.arange(window + 1), counts)
        rank = np.concatenate([np.arange(n) for n in counts]) if counts.any() else np.zeros(0, int)
        where, offset = plan.place(length, rank)
        ends: dict = {}
        for w, o, n in sorted(zip(where.tolist(), offset.tolist(), length.tolist())):
            assert ends.get(w, 0) == o and o + n <= window
            ends[w] = o + n
        assert len(ends) == plan.windows
