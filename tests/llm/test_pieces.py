import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vouchlake.llm.piecebpe import PieceModel, encode_decode, encode_decode_digest, model_bytes


@pytest.fixture(scope="module")
def own():
    return PieceModel(model_bytes())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes())


def same(own, library, text):
    ids = np.frombuffer(own.encode(text), "<u4")
    expected = library.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == expected
    assert own.decode(ids) == library.decode(expected)


def test_documents_equal_the_library(spark, sf_medium, own, library):
    for r in spark.read.parquet(f"{sf_medium}/documents.parquet").select("text").collect():
        same(own, library, r.text)


def test_strings_of_pieces_equal_the_library(own, library):
    rng = random.Random(7)
    pieces = [p.replace("▁", " ") for p in own.score]
    for _ in range(5000):
        same(own, library, "".join(rng.choice(pieces) for _ in range(rng.randrange(7))))


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_string_equals_the_library(text):
    import sentencepiece

    same(_OWN[0], _OWN[1], text) if _OWN else _OWN.extend((PieceModel(model_bytes()), sentencepiece.SentencePieceProcessor(model_proto=model_bytes())))


_OWN: list = []


def test_odd_rows(odd_docs, no_docs, library):
    rows = encode_decode(odd_docs).collect()
    texts = [r.text for r in odd_docs.select("text").collect()]
    assert sorted(map(str, (r.ids for r in rows))) == sorted(str(library.encode(t or "", add_bos=True, add_eos=True)) for t in texts)
    digest = {r.doc_id: r for r in encode_decode_digest(odd_docs).collect()}
    assert digest[3].n_tokens == digest[4].n_tokens == 2
    assert digest[4].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    ids = library.encode("one two", add_bos=True, add_eos=True)
    assert digest[7].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert encode_decode(no_docs).count() == encode_decode_digest(no_docs).count() == 0
