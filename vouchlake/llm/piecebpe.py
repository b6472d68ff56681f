"""Encoding and decoding with a BPE piece model, by the prefix table of unique last tokens.

For merge-type vocabularies the encoding of every prefix of a string ends in one token
that no longer context can change. So one pass over the string suffices: at each end
position take the pieces that an Aho-Corasick automaton finds ending there, and keep the
one whose left neighbour (the stored last token of the shorter prefix) is compatible
with it, that is, whose pair encodes to just these two tokens. Ids are read backwards
from the last position.

The string is cut beforehand where no piece holds the two neighbouring characters:
nothing can merge across such a place, and the parts repeat enough to be remembered.

Null text counts as empty, and an empty text has the begin and end ids alone. Rows
repeat as often as they come; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .samples import read_table
from .workspace import worker_cache

SPACE = "▁"
_MEMO, _PAIRS = 400_000, 600_000


class PieceModel:
    """Vocabulary of a piece model file: pieces with merge scores, and byte pieces for the rest."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.joined = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        #: what each id stands for in the decoded bytes
        self.raw = [
            b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) > 1 and self.merge(p) == [p]:  # others can never come out of merging
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.singles = {p: i for p, i in self.id_of.items() if len(p) == 1}
        self._pairs: dict[int, bool] = {}
        self._segments: dict[str, bytes] = {}
        self.words = _Words(self)

    def merge(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost on ties; for the tests of short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > _PAIRS:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            ok = self._pairs[key] = self.merge(a + b) == [a, b] if a[-1] + b[0] in self.joined else True
        return ok

    def prefix_table(self, part: str) -> tuple[list[int], list[int]]:
        """For each prefix, its last token, and that token's length."""
        singles, pairs = self.singles, self._pairs
        last, size, settled = [singles[c] for c in part], [1] * len(part), -1
        for at, (token, length) in self.automaton.iter(part):  # ends in rising order, so what lies before is settled
            if at == settled:
                continue
            before = at - length
            if before >= 0:
                ok = pairs.get(last[before] << 32 | token)
                if not (self.compatible(last[before], token) if ok is None else ok):
                    continue
            last[at], size[at], settled = token, length, at
        return last, size

    def segment(self, part: str) -> bytes:
        """Ids of a stretch in which every neighbouring pair occurs within some piece."""
        if len(part) == 1:
            one = self.singles.get(part)
            ids = [one] if one is not None else [self.byte_id[x] for x in part.encode()]
        else:
            (last, size), ids, at = self.prefix_table(part), [], len(part) - 1
            while at >= 0:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, word: str) -> bytes:
        """Ids of a word, cut where nothing can merge."""
        joined, memo, start, out = self.joined, self._segments, 0, b""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        cuts.append(len(word))
        for k in cuts:
            part = word[start:k]
            ids = memo.get(part)
            if ids is None:
                ids = self.segment(part)
                if k - start <= 40:
                    if len(memo) > _MEMO:
                        memo.clear()
                    memo[part] = ids
            out += ids
            start = k
        return out

    def encode(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return np.array([self.begin, self.end], "<u4").tobytes()
        marked = SPACE + text.replace(" ", SPACE)
        words = _RUNS.findall(marked)
        return np.array([self.begin], "<u4").tobytes() + b"".join(map(self.words.__getitem__, words)) + np.array([self.end], "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the space that encoding puts in front."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Words(dict):
    """word -> ids, kept while there is room."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        if len(self) > _MEMO:
            self.clear()
        ids = self.model.encode_word(word)
        if len(word) <= 40:
            self[word] = ids
        return ids


#: a run of space marks with what follows up to the next; no piece holds a mark after another character
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded text of every row."""
    return _mapped(docs, path, "ids array<int>, decoded string", lambda ids, text: (np.frombuffer(ids, "<u4").astype(np.int32), text))


def encode_decode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text of every row."""
    return _mapped(
        docs,
        path,
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()),
    )


def _mapped(docs: DataFrame, path: str | None, columns: str, of) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    kinds = {"ids array<int>": pa.list_(pa.int32()), "n_tokens long": pa.int64()}
    fields = [(c.split()[0], kinds.get(c, pa.string())) for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto = shared.value
        model = worker_cache(f"piece-{hashlib.sha256(proto).hexdigest()}", lambda: PieceModel(proto))
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                ids = model.encode(text or "")
                rows.append(of(ids, model.decode(np.frombuffer(ids, "<u4"))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields))],
                names=["doc_id", *(name for name, _ in fields)],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digest(read_table(spark, sf_dir, "documents"))
