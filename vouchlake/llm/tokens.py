"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import json
import re

import numpy as np

from .workspace import give_back, worker_cache


def vocabulary_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The tokenizer file, read on the driver and broadcast, so that executors need no copy."""
    with open(vocabulary_path(path), "rb") as f:
        return f.read()


class ByteBpe:
    """The ids that the tokenizers library gives for a byte-level BPE file, without added special tokens.

    Ordinary text goes through tiktoken with the same vocabulary (equal ids, about three
    times as fast); a text that holds a special token's string goes through tokenizers itself.
    tiktoken's pattern looks ahead once for each mark of a run of white space and overflows
    its stack on some 300,000 of them (and takes time with the square of a run), so runs of LONG_RUN marks or more are cut out first:
    the pattern always makes one word of a run but its last mark (of the whole run at the
    end of the text), and that word is merged on its own. The ids are the same.
    """

    def __init__(self, spec: bytes):
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        parsed = json.loads(spec)
        self.special = [x["content"] for x in parsed.get("added_tokens", [])]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in parsed["model"]["vocab"].items() if piece not in self.special}
        self.size = 1 + max([*parsed["model"]["vocab"].values(), *(x["id"] for x in parsed.get("added_tokens", []))])
        self._spec, self._library = spec, None
        self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        """The library's own tokenizer; made when a text first needs it, as it takes as much memory again."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._spec.decode())
        return self._library

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        out: list[int] = []
        start = 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.fast.encode_ordinary(text[start : run.start()])
            out += self.fast._encode_single_piece(text[run.start() : end])
            start = end
        return np.array(out + self.fast.encode_ordinary(text[start:]) if start else self.fast.encode_ordinary(text), np.int64)


#: Fixed value: how byte-level BPE of this vocabulary cuts text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space (the Unicode property, which the pattern's white space means) in runs too long for one look-ahead.
LONG_RUN = 400
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenizer(spec: bytes) -> ByteBpe:
    """One tokenizer a Python worker."""


    def make() -> ByteBpe:
        give_back()
        made = ByteBpe(spec)
        give_back()
        return made

    return worker_cache(f"byte-bpe-{hash(spec)}", make)
