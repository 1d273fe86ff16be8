"""Ids of whole texts as the ``tokenizers`` library gives them, one library call for each
distinct pre-token.

Byte-level BPE encodes each pre-token by itself, so a text's ids are those of its
pre-tokens in order. Pre-tokens repeat; their ids are kept in a table of bounded size,
and the library encodes those that are new, many at a time. A text outside the range
in which the scanner here and the library's certainly agree (Latin letters and plain
marks), or with the library's special string, goes to the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Texts of these characters alone are scanned here.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*\Z")
#: The same pre-tokens as the library's pattern, over PLAIN characters. The classes state
#: which of them are letters and which are other numbers or marks.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r"\t\n\r \xa0"
SCAN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Pre-tokens kept at once in a Python worker.
KEPT = 1_000_000


@functools.lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """``ids``: a text's ids; ``scan``: its pre-tokens."""

    def __init__(self, path: str, kept: int = KEPT):
        self.lib, self.kept, self.table = library(path), kept, {}
        self.special = [x.content for x in self.lib.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bool:
        return bool(PLAIN.match(text)) and not any(x in text for x in self.special)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, tokens: list[str]) -> None:
        new = set(tokens).difference(self.table)
        if not new:
            return
        if len(self.table) + len(new) > self.kept:
            self.table.clear()
            new = set(tokens)
        new = list(new)
        for x, e in zip(new, self.lib.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.table[x] = np.asarray(e.ids, "<u4").tobytes()

    def bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.plain(text):
            return self.whole(text).tobytes()
        tokens = SCAN.findall(text)
        self.learn(tokens)
        return b"".join(map(self.table.__getitem__, tokens))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.bytes(text), "<u4")

    def scan(self, text: str) -> list[str]:
        """Pre-tokens of a text in which no special string is."""
        if PLAIN.match(text):
            return SCAN.findall(text)
        return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
