"""Exact token counts at every prefix of a text, by dynamic programming.

For each text an array holds the number of tokens of each of its prefixes, by code points.
It is put together from arrays of its pre-tokens, which repeat and are kept: count at a place
within a pre-token = count before the pre-token + count at that place of it. A pre-token's own
array comes from a dynamic programme over its bytes: the encoding of the first k bytes ends
with the only token t such that the encoding of the first k - len(t) bytes ends with a token u
for which (u, t) is what the pair's own bytes encode to; count[k] = count[k - len(t)] + 1.
Where a prefix ends inside white space of several characters, that is one pre-token as far as
it goes, whatever the text has after it. The number of tokens, truncation and budget
questions are then answered by looking up, without encoding again.

Cases: a null or empty text has 0 tokens and 0 bytes; a null id is kept; equal rows each
give a row; an empty table gives an empty one; further columns are dropped.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.pretokens import Encoder
from kinfold.llm.shared import small_batches

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the
    code points from 256 on, in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(other)}


#: Pre-tokens whose arrays a Python worker keeps at once, and beginnings of them with their arrays,
#: counts and last tokens; of those no longer ones than SHORT bytes.
KEPT, STEPS, SHORT = 1_000_000, 500_000, 24
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)\Z")
#: White space as the library's scanner has it.
SPACE_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


class PrefixCounts:
    """Prefix counts of texts for one tokenizer."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        letters = byte_letters()
        self.letters = letters
        self.special = re.compile("|".join(map(re.escape, sorted(self.encoder.special, key=len, reverse=True))) or r"(?!)")
        self.vocabulary = set(self.encoder.lib.get_vocab(with_added_tokens=False))
        #: By their last two letters, the length of the longest tokens.
        self.reach: dict[str, int] = {}
        for t in self.vocabulary:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 1))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.inner: dict[str, bytes] = {}
        self.steps: dict[str, tuple[bytes, int, str]] = {}

    def follows(self, u: str, t: str) -> bool:
        """Whether the bytes of u and t together encode to just u, t."""
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        found = self.pairs[u, t] = [x.value for x in self.encoder.lib.model.tokenize(u + t)] == [u, t]
        return found

    def inside(self, token: str) -> bytes:
        """Counts at each prefix of one pre-token, from 1 code point to all, as 32-bit integers."""
        if token[0] == "'" and CONTRACTION.match(token):  # cut short, it is a mark and a letter
            return np.array([*[1, 2][: len(token) - 1], np.frombuffer(self.over_bytes(token), "<u4")[-1]], "<u4").tobytes()
        return self.over_bytes(token)

    def over_bytes(self, token: str) -> bytes:
        raw = token.encode()
        s = raw.decode("latin-1").translate(self.letters)
        steps = self.steps
        if len(steps) > STEPS:
            steps.clear()
        # from the longest beginning that is known, whose own beginnings are known too
        k = head = min(len(s), SHORT)
        while k and s[:k] not in steps:
            k -= 1
        counts = steps[s[:k]][0] if k else b""
        further: list[tuple[None, int, str]] = []
        vocabulary, reach, pairs = self.vocabulary, self.reach, self.pairs
        for k in range(k + 1, len(s) + 1):
            for n in range(min(k, reach.get(s[max(k - 2, 0) : k], 1)), 0, -1):
                t = s[k - n : k]
                if t in vocabulary:
                    if n == k:
                        c = 1
                        break
                    _, c, u = steps[s[: k - n]] if k - n <= head else further[k - n - head - 1]
                    if pairs[u, t] if (u, t) in pairs else self.follows(u, t):
                        c += 1
                        break
            if k <= head:
                counts += c.to_bytes(4, "little")
                if k < len(s):
                    steps[s[:k]] = counts, c, t
            else:
                further.append((None, c, t))
        if further:
            counts += np.array([c for _, c, _ in further], "<u4").tobytes()
        if len(raw) == len(token):
            return counts
        return b"".join([counts[4 * j : 4 * j + 4] for j in range(len(raw)) if j + 1 == len(raw) or raw[j + 1] & 0xC0 != 0x80])  # ends of code points

    def ordinary(self, text: str) -> np.ndarray:
        """Counts at each prefix of a text without special strings, from 0 code points to all."""
        if not text:
            return np.zeros(1, np.int64)
        tokens, inner = self.encoder.scan(text), self.inner
        if len(inner) > KEPT:
            inner.clear()
        for x in set(tokens).difference(inner):
            inner[x] = self.inside(x)
        parts = np.frombuffer(b"".join(map(inner.__getitem__, tokens)), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes)
        own = parts[ends - 1]
        parts += np.repeat(np.cumsum(own) - own, sizes)
        out = np.concatenate([[0], parts])
        for m in SPACE_RUN.finditer(text):
            e = m.end()
            if e < len(text):  # the last of a run, which what follows takes or splits off
                out[e] = out[m.start()] + np.frombuffer(self.inside(m.group()), "<u4")[-1]
        return out

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for each k from 0 to the text's length."""
        out, at = [np.zeros(1, np.int64)], 0
        if not any(x in text for x in self.encoder.special):
            return self.ordinary(text)
        for m in self.special.finditer(text):
            # a special string is one token if it is whole, and ordinary text after what is before it if not
            one, size = self.ordinary(text[at : m.end()]), m.start() - at
            base = int(out[-1][-1])
            out.append(base + one[1:-1])
            out.append(np.array([base + one[size] + 1]))
            at = m.end()
        rest = self.ordinary(text[at:])
        return np.concatenate([*out, int(out[-1][-1]) + rest[1:]])

    @staticmethod
    def cut(table: np.ndarray, budget: int) -> int:
        """The most code points k for which all prefixes up to k have budget tokens at most."""
        over = table > budget
        return int(over.argmax()) - 1 if over.any() else len(table) - 1


@functools.lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit``) and limit_chars: how many
    code points can be kept within the limit. All are read off the text's array of counts."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = prefix_counts(path)
        for b in batches:
            out = []
            for text in b.text:
                t = counts.table(text)
                n = int(t[-1])
                out.append((len(text.encode()), n, n > limit, counts.cut(t, limit)))
            yield pd.concat([b[["doc_id"]].astype({"doc_id": "Int64"}), pd.DataFrame(out, columns=["n_bytes", "n_tokens", "over_limit", "limit_chars"])], axis=1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
