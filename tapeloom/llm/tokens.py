"""Encoding with public tokenizers, each distinct piece of text encoded once.

The pre-tokenizers cut a text into pieces before any merge. A text is cut here
only at places where they always cut too: before the last character of a white
space run that a non-blank follows, and after a run of Latin letters that ASCII
follows. The ids of the parts, one after another, are then the ids of the whole
text; a part new to the worker goes through the tokenizer's own normalizer,
pre-tokenizer and merge model. Texts with special token strings, or with control characters that Python
and the tokenizer class differently, are encoded whole.
"""

from __future__ import annotations

import os
import re

import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

_PART = re.compile(r"\s?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\x00-\x7f]|\Z)|\s?\S+|\s+(?!\S)")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS = " " + "".join(filter(str.isalpha, map(chr, [*range(65, 123), *range(0xC0, 0x100)])))
_WHOLE = re.compile(r"<\||[\x1c-\x1f]")


def find(name: str) -> str:
    """Path of a public vocabulary file."""
    return public_tokenizers.path(name)


class Encoder(dict):
    """Little-endian unsigned 32-bit ids of texts; the parts seen before are kept, `limit` at most."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.limit, self.tokenizer = limit, Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        # What normalizer and pre-tokenizer make of each single letter; a Latin word is one piece of such letters.
        self.letters = str.maketrans({c: "".join(self.pieces(c)) for c in _LETTERS})

    def pieces(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer
        text = normal.normalize_str(text) if normal else text
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process, so that later tasks find the parts of earlier ones."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        pieces = [part.translate(self.letters)] if _WORD.fullmatch(part) else self.pieces(part)
        ids = self[part] = b"".join([t.id.to_bytes(4, "little") for piece in pieces for t in self.merges.tokenize(piece)])
        return ids

    def whole(self, text: str) -> bytes:
        """Ids by one plain call of the tokenizer."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as bytes; null counts as empty."""
        if not text:
            return b""
        if _WHOLE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PART.findall(text)))
