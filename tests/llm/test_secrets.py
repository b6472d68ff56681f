import hashlib
import random
import re
import zlib

import pytest

from vouchlake.llm import secretscan as S

WORD = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + ")"
PLAIN = {
    "assign": (WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    """The contract's kinds, sought over the whole text by plain expressions."""
    return sorted((m.start(), k, m.end()) for k, (e, ok) in enumerate(PLAIN.values()) for m in re.finditer(e, text) if ok(m))


def crc_token(head, body):
    value, out = zlib.crc32(body.encode()), ""
    while len(out) < 6:
        out, value = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[value % 62] + out, value // 62
    return head + body + out


def xprv():
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    value, out = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big"), ""
    while value:
        value, k = divmod(value, 58)
        out = S.BASE58[k] + out
    return out


#: The test key of the format's public description.
AGE = "AGE-SECRET-KEY-1GFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPQ4EGAEX"


@pytest.fixture(scope="module")
def scanner():
    return S.Scanner()


@pytest.mark.parametrize("seed", range(6))
def test_equals_searching_whole_texts(scanner, seed):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "SECRET", "toKen", "api_key", "APIKEY", "AKIA", "akia", "=", ":", " ", '"', "'", "abc", "abcdef", "0123456789ab", "deadbeef", "DEADBEEF", "Z9", "ſecret", "toKen", "é", "日本", "\n", "-", "/", "_", "x"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randrange(40)))
        assert [x for x in scanner.spans(text) if x[1] < 3] == brute(text)


def test_no_keyword_lies_within_another_of_its_kind():
    """So hits of a kind come in the order of their starts."""
    for words, _, _ in S.KINDS.values():
        if len(words) < 100:
            assert not any(a != b and a in b for a in words for b in words)


def test_checksums(scanner):
    good = [crc_token("ghp_", "a1B2" * 7 + "zz"), crc_token("npm_", "Zq0" * 10), xprv(), AGE]
    text = " and ".join(good)
    assert [(scanner.names[k], text[a:e]) for a, k, e in scanner.spans(text) if k >= 3] == list(zip(["github", "npm", "xprv", "age"], good))
    for k, token in enumerate(good):
        changed = token[:-9] + ("2" if token[-9] != "2" else "3") + token[-8:]
        assert not [x for x in scanner.spans(changed) if x[1] == 3 + k], token
        assert not [x for x in scanner.spans(token + "A2") if x[1] == 3 + k]


def test_failing_matches_cover_their_characters(scanner):
    assert scanner.spans("token=token") == brute("token=token") == []
    assert scanner.spans("token: secret: abcdefgh") == brute("token: secret: abcdefgh") == [(0, 0, 13)]
    assert scanner.masked("my token=abcdef0123456789abcdef01 end") == "my [assign] end"


def test_long_runs_cost_their_length(scanner):
    for text in ("token" * 200_000, "ab" * 500_000, "AKIA" * 200_000, "password" + " " * 1_000_000, "ghp_" * 200_000):
        assert [x for x in scanner.spans(text) if x[1] < 3] == brute(text)


def test_query_equals_brute_force(spark, sf_medium):
    rows = {r.doc_id: r for r in __import__("__spark_entry__").queries()["op12_secrets"](spark, sf_medium).collect()}
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_assign for r in rows.values()) > 0
    for d in docs:
        said = [(a, list(PLAIN)[k], e) for a, k, e in brute(d.text or "")]
        joined = ",".join(f"{k}:{a}:{e}" for a, k, e in said)
        r = rows[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in said) for x in PLAIN)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == joined


def test_odd_rows(spark, odd_docs, no_docs):
    got = S.scan(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.spans == [] for r in got)
    assert S.scan(no_docs).count() == 0 and S.mask(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "é token='abcdef' x"), (1, "é token='abcdef' x"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.spans]) for r in S.scan(docs).collect()) == [(0, []), (1, [("assign", 2, 15)]), (1, [("assign", 2, 15)])]
    assert {r.text for r in S.mask(docs).collect()} == {"é [assign]' x", ""}
