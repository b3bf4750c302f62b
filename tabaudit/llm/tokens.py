"""Byte-level BPE ids of texts, as the ``tokenizers`` library gives them, with the words of a text looked up.

A text is split into the words of the tokenizer's own pattern; the ids of a word do not depend on its neighbours, so
each worker keeps the ids of words it has seen in two generations of bounded size. New words are encoded from the
same vocabulary as ranks. The split uses Python's classes of letters, digits and spaces, which agree with the
tokenizer's on most characters; a text with any other character is given to ``tokenizers`` whole.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tabaudit.llm.common import code_points

REMEMBERED = 300_000
# The pattern of the vocabulary in Python's classes: [^\W\d_] letters, \d digits.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _odd_characters() -> np.ndarray:
    """Code points that Python's classes and the pattern's may put in different classes."""
    odd = np.ones(0x110000, bool)
    for c in range(0x30000):
        ch, kind = chr(c), unicodedata.category(chr(c))
        letter, digit, space = ch.isalnum() and not ch.isdecimal(), ch.isdecimal(), ch.isspace()
        white = kind[0] == "Z" or c in (9, 10, 11, 12, 13, 0x85)
        odd[c] = kind in ("Cn", "Cs") or (letter, digit, space) != (kind[0] == "L", kind[0] == "N", white)
    return odd


class Encoder:
    """Text to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str = "byte_bpe_50k"):
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.whole.encode_special_tokens = True
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.odd = _odd_characters()
        self.odd_ascii = [chr(c) for c in np.flatnonzero(self.odd[:128])]
        self.seen = _Seen(self.words)

    def _is_odd(self, text: str) -> bool:
        if text.isascii():
            return any(c in text for c in self.odd_ascii)
        return bool(self.odd[code_points(text)].any())

    def __call__(self, text: str) -> bytes:
        if self._is_odd(text):
            return _packed(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.seen) > REMEMBERED:
            self.seen = _Seen(self.words, self.seen)
        return b"".join(map(self.seen.__getitem__, WORD.findall(text)))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Seen(dict):
    """Ids of words; a word that is not here is taken from the older generation or encoded."""

    def __init__(self, words: tiktoken.Encoding, older: dict | None = None):
        super().__init__()
        self.words = words
        self.older = dict(older) if older else {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = _packed(self.words.encode_ordinary(word))
        self[word] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of this worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
