"""The rows of the whole pipeline against plain Python: which documents are bad and which are copies
is known from how they were made, the mix and the ids are computed again without Spark."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from kinfold.llm import bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SOURCES = ["a", "b", "ä", None]
WEIGHTS = (5, 2, 1)


def made(r):
    """Rows of documents, their labels, and the ids that the first three stages keep."""
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.choice([2, 3, 5, 7, 8])))
    prose = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n))
    texts, bad, copies = [], set(), set()

    def add(text):
        texts.append(text)
        return len(texts) - 1

    for _ in range(500):
        text = prose(r.randint(40, 300))
        add(text)
        if r.random() < 0.15:  # one word of at least 40 differs: 31 of 41 shingles or more are shared
            w = text.split()
            w[-1] = word() + "x"
            copies.update(add(t) for t in [text, " ".join(w)][: r.randint(1, 2)])
    for _ in range(30):
        bad.add(add(" ".join(word() + r.choice(["%%%", "***", "$$$"]) for _ in range(80))))
        bad.add(add(" | ".join(word() for _ in range(60))))
        bad.add(add(" ".join(w for w in (word() for _ in range(40)) for _ in range(4))))
        bad.add(add(" ".join(word().upper() + "!!" for _ in range(60))))
    bad.update(add(t) for t in (None, "", " \n ", "too few words"))
    rows = [(k, t, "en", SOURCES[k % 7 % 4], len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, int(k not in bad), 0) for k in range(len(texts)) if k % 10]
    return rows, labels, [k for k in range(len(texts)) if k not in bad | copies]


def mixed(rows):
    """Ids and texts of the mix."""
    size = {k: len(WORD.findall(t)) for k, t, *_ in rows}
    of = collections.defaultdict(list)
    for k, t, _, s, _ in rows:
        of[s].append((int(hashlib.md5(f"mix|{k}".encode()).hexdigest()[:12], 16), k, t))
    weigh = {s: WEIGHTS[j % 3] for j, s in enumerate(sorted(of, key=lambda s: (s is None, s or "")))}
    cap = {s: 2 * sum(size[k] for _, k, _ in of[s]) for s in of}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(of)
    while open_:
        level = left / sum(weigh[s] for s in open_)
        full = {s for s in open_ if cap[s] <= weigh[s] * level}
        target |= {s: cap[s] for s in full} if full else {s: weigh[s] * level for s in open_}
        left -= sum(cap[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s, docs in of.items():
        budget = math.floor(target[s])
        for _ in range(2):
            for _, k, t in sorted(docs):
                n = min(size[k], budget)
                budget -= n
                if n:
                    out.append((k, t if n == size[k] else t[: [m.end() for m in WORD.finditer(t)][n - 1]]))
    return out


def test_rows(spark, tmp_path):
    rows, labels, stay = made(random.Random(21))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
    want = []
    for k, t in mixed([rows[k] for k in stay]):
        ids = encoding.encode_ordinary(t)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
