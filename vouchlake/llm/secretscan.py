"""Secrets in whole texts: a keyword automaton, anchored expressions at its hits, embedded checksums.

One Aho-Corasick pass over a text finds every keyword with which a secret can begin
(and, for runs of hex digits, every four of them). Only at those places an expression is
tried, anchored there, and a match that carries a checksum must satisfy it. A kind's
matches are its leftmost ones that don't overlap; one that fails its check still covers
its characters, as if the expression had been sought over the whole text.

Kinds: `assign` (a named value), `access` (an access key id) and `hex` as patterns with a
least length; `github` and `npm` (tokens whose last six characters are the CRC32 of the
thirty before, in base 62), `xprv` (extended private keys, Base58Check) and `age` (secret
keys, Bech32) by checksum.

A null text counts as empty and has no spans. Positions are code points, ends exclusive.
Rows are taken one by one: repeated rows and ids, null ids and ties give a row each, other
columns are not carried, and an empty table gives no rows. Texts of any length are
scanned once from end to end; a run of keywords or hex digits costs no more than its length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import read_table
from .workspace import worker_cache

# Keywords and expressions of the contract's kinds, alphabets and token forms.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

_HEX_PIECE = 4


def crc_token(body: str) -> bool:
    """Whether the last six of 36 characters are the CRC32 of those before, in base 62."""
    value, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, k = divmod(value, 62)
        digits = BASE62[k] + digits
    return digits == body[-6:]


def base58_checked(text: str) -> bool:
    """Whether the last four of 82 bytes begin the double SHA-256 of those before."""
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 8 * 82:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_checked(text: str) -> bool:
    """Whether a Bech32 string's last six characters check what comes before."""
    head, _, tail = text.lower().rpartition("1")
    rest = 1
    for v in [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [BECH32.index(c) for c in tail]:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for k, step in enumerate(BECH32_STEPS):
            rest ^= step if top >> k & 1 else 0
    return rest == 1


#: kind -> (keywords in lower case, expression, check of a match)
KINDS: dict[str, tuple[tuple[str, ...], str, Callable[[re.Match], bool]]] = {
    "assign": (ASSIGN_WORDS, ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (("akia",), "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (tuple(map("".join, product("0123456789abcdef", repeat=_HEX_PIECE))), "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc_token(m[0][4:])),
    "npm": (("npm_",), "npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc_token(m[0][4:])),
    "xprv": (("xprv",), f"xprv[{BASE58}]{{107}}(?![{BASE58}])", lambda m: base58_checked(m[0])),
    "age": (("age-secret-key-1",), f"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}(?![0-9A-Z])", lambda m: bech32_checked(m[0])),
}
BASE = ("assign", "access", "hex")


class Scanner:
    """Finds the spans of all kinds in a text."""

    def __init__(self) -> None:
        import ahocorasick

        self.names = list(KINDS)
        self.words = ahocorasick.Automaton()
        for k, (words, _, _) in enumerate(KINDS.values()):
            for w in words:
                self.words.add_word(w, (k, len(w)))
        self.words.make_automaton()
        self.tries = [(re.compile(e, re.A).match, check) for _, e, check in KINDS.values()]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), by start and kind."""
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: places stay
        done = [0] * len(self.tries)
        out = []
        for last, (kind, size) in self.words.iter(lowered):
            start = last + 1 - size
            if start < done[kind]:
                continue
            match, check = self.tries[kind]
            if m := match(text, start):
                done[kind] = m.end()
                if check(m):
                    out.append((start, kind, m.end()))
        out.sort()
        return out

    def masked(self, text: str) -> str:
        """The text with every span, or spans that touch or overlap, as one mark that names the first one's kind."""
        out, at, until = [], 0, 0
        for start, kind, end in self.spans(text):
            if start >= until:
                out += [text[at:start], f"[{self.names[kind]}]"]
            at = until = max(until, end)
        return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _each(docs: DataFrame, name: str, kind: str, arrow: pa.DataType, of: Callable[[Scanner, str], object]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_cache("secret-scanner", Scanner)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([of(scanner, t or "") for t in b.column("text").to_pylist()], arrow)], names=["doc_id", name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {name} {kind}")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end) of every row, by start, then kind as listed in KINDS."""
    return _each(
        docs, "spans", "array<struct<kind: string, start: bigint, end: bigint>>", _SPANS,
        lambda s, text: [{"kind": s.names[k], "start": a, "end": e} for a, k, e in s.spans(text)],
    )


def mask(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row with its secrets replaced by the names of their kinds."""
    return _each(docs, "text", "string", pa.string(), lambda s, text: s.masked(text))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kinds(*kinds: str) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(*kinds))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(_of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(_of_kinds(*BASE)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
