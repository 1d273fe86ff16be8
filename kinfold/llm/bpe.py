"""Byte-level BPE encoding and decoding by overlapping chunks.

Each text is cut into chunks of ``chunk`` code points that overlap, and each chunk is
pre-tokenised by itself. Neighbouring chunks are stitched at the first position of their
overlap where the pre-token boundaries of both agree. A piece is what lies between two
stitches; it is encoded by itself, and the ids of the pieces in order are the ids of the
text. Decoding concatenates the raw bytes of the ids. Chunks of a text of more than ``deal``
code points are rows of their own, dealt out over the cluster, so that no task encodes a very
long text alone; those of other texts are worked on where the text was read.

Why the stitch is exact: in each of the pattern's alternatives a run of letters or of digits
goes on as far as it can, and white space stands only at a pre-token's beginning, so that the
end of such a run, and of what white space follows, is a boundary for every chunk that sees it,
wherever its own scan began. Only such boundaries are taken. If the overlap has none it is
made longer until it has one, or ends with the text: a rest without any is one pre-token, or
marks alone.

Cases: a null or empty text has no ids; a null id is kept; rows that are equal each
give a row; an empty table gives an empty one; further columns are dropped.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import small_batches

RANKS = "byte_bpe_50k.tiktoken"
CHUNK = 2048
OVERLAP = 256
DEAL = 262_144
#: The end of a pre-token for certain.
SURE = regex.compile(r"\S(?=\s)|\p{L}(?=\P{L})|\p{N}(?=\P{N})")
PIECE_SCHEMA = "row_id long, doc_id long, seq int, pieces int, ids binary, raw binary"
DIGEST_SCHEMA = "row_id long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding whose ranks are in the file at ``path``, without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_piece(enc: tiktoken.Encoding, pattern: str, text: str) -> list[int]:
    """Ids of a text; a run that the library's own scanner gives up on is scanned here."""
    try:
        return enc.encode_ordinary(text)
    except BaseException as e:  # the library's scanner panics on runs of about a million characters
        if type(e).__name__ != "PanicException":  # its class cannot be imported
            raise
        return [i for x in regex.findall(pattern, text) for i in enc._encode_single_piece(x.encode())]


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(text of the chunk, where in it the overlap with the next one starts; -1 for the last)."""
    out, start = [], 0
    while start + chunk < len(text):
        zone = start + chunk
        sure = SURE.search(text, zone)
        if not sure:
            break
        out.append((text[start : min(len(text), max(zone + overlap, sure.end() + 8))], chunk))
        # the next chunk begins where the overlap does, but never far before the boundary: a long run
        # without any is in one chunk alone
        start = zone if sure.start() < zone + overlap else sure.start()
    return [*out, (text[start:], -1)]


def stitches(text: str, zone: int, first: bool, pattern: str) -> tuple[int, int]:
    """The part of a chunk that is its own piece: from the stitch with the chunk before to
    the stitch with the one after, both boundaries of this chunk's own pre-tokens."""
    ends = set(itertools.accumulate(map(len, regex.findall(pattern, text))))

    def sync(at: int) -> int:
        return next(m.end() for m in SURE.finditer(text, at) if m.end() in ends)

    return 0 if first else sync(0), len(text) if zone < 0 else sync(zone)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, deal: int = DEAL) -> DataFrame:
    """A row for each text, or for each piece of one that is dealt out: row_id, doc_id, seq, pieces
    (rows of this text), ids (little-endian unsigned 32-bit integers), raw, the bytes that the ids
    decode to, and dealt (whether the text is beyond ``deal``)."""
    spark = docs.sparkSession
    small_batches(spark)
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def piece(text: str, zone: int, seq: int) -> list[int]:
        """Ids of the piece of one chunk."""
        a, b = stitches(text, zone, seq == 0, pattern) if zone >= 0 or seq else (0, len(text))
        return encode_piece(encoding(path, pattern), pattern, text[a:b])

    def row(row_id, doc_id, seq, n, ids: list[int]) -> tuple:
        return row_id, None if pd.isna(doc_id) else int(doc_id), seq, n, np.asarray(ids, "<u4").tobytes(), encoding(path, pattern).decode_bytes(ids)

    def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    columns = ["row_id", "doc_id", "seq", "pieces", "ids", "raw"]

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, d, t in zip(b.row_id, b.doc_id, b.text, strict=True):
                out.append(row(r, d, 0, 1, [i for k, (x, z) in enumerate(chunks(t, chunk)) for i in piece(x, z, k)]))
            yield frame(out, columns)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, d, t in zip(b.row_id, b.doc_id, b.text, strict=True):
                parts = chunks(t, chunk)
                yield frame([(r, None if pd.isna(d) else int(d), k, len(parts), z, x) for k, (x, z) in enumerate(parts)], ["row_id", "doc_id", "seq", "pieces", "zone", "text"])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield frame([row(r, d, k, n, piece(t, z, k)) for r, d, k, n, z, t in zip(b.row_id, b.doc_id, b.seq, b.pieces, b.zone, b.text, strict=True)], columns)

    near = rows.where(F.length("text") <= deal).mapInPandas(here, PIECE_SCHEMA)
    far = rows.where(F.length("text") > deal).mapInPandas(cut, "row_id long, doc_id long, seq int, pieces int, zone int, text string")
    # a constant of each branch, by which a reader of one of them leaves the other unread
    far = far.repartition("row_id", "seq").mapInPandas(dealt, PIECE_SCHEMA).withColumn("dealt", F.lit(True))
    return near.withColumn("dealt", F.lit(False)).unionByName(far)


def digests(pieces: DataFrame) -> DataFrame:
    """n_tokens and the digests of ids and of decoded bytes of each text, read piece by piece:
    of a text of many pieces no task ever holds more than one."""
    one = pieces.where("NOT dealt").select("row_id", "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = b = n = None
        for x in batches:
            out = []
            for r, d, k, m, ids, raw in zip(x.row_id, x.doc_id, x.seq, x.pieces, x.ids, x.raw, strict=True):
                if k == 0:
                    a, b, n = hashlib.sha256(), hashlib.sha256(), 0
                a.update(ids)
                b.update(raw)
                n += len(ids) // 4
                if k == m - 1:
                    out.append((r, None if pd.isna(d) else int(d), n, a.hexdigest(), b.hexdigest()))
            yield pd.DataFrame(out, columns=["row_id", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    many = pieces.where("dealt").drop("dealt").repartition("row_id").sortWithinPartitions("row_id", "seq").mapInPandas(roll, DIGEST_SCHEMA)
    return one.unionByName(many).drop("row_id")
