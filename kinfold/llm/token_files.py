"""Token ids in binary files of fixed-width packed ids.

File format, all integers little-endian:
  header   8 bytes ``KFPACK01``, u32 bits an id, u32 ids a block, u64 ids, u64 documents
  payload  blocks of ``ids a block`` ids; id i of a block takes bits [i*b, (i+1)*b), lowest
           first, and a block begins at a byte
  index    for each document: i64 doc_id, u8 whether it is null, u64 its first id in the file;
           then for each block u64 the byte where it starts in the payload
  footer   u64 the byte where the index starts
Bits are the fewest that hold the vocabulary. A document's ids are found by its first id:
block = first // ids a block, so that any span is read without what is before it.

One file for each range of doc_id; ranges ascend with the file number. Files are written
under a name of the attempt and then renamed, so that a task that runs again after a lost
executor leaves the same file. They go where ``spark.checkpoint.dir`` points, by any file
system that pyarrow knows.

Cases: a null or empty text holds the end id alone; null ids come first; equal ids keep
the order of their texts' hashes; an empty table gives no documents; other columns drop.
"""

from __future__ import annotations

import functools
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.pretokens import Encoder
from kinfold.llm.shared import new_path, small_batches, written

TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"KFPACK01"
HEADER = struct.Struct("<8sIIQQ")
BLOCK = 8192
READ_BLOCKS = 128
END_ID = 0


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of one block, ``bits`` each."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    b = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(b.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The n ids of a block."""
    raw = np.frombuffer(raw, np.uint8)
    if bits == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    b = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(np.pad(b, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """One file; holds a block of ids and the index, not the payload."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.waiting, self.ids, self.docs, self.offsets, self.bytes = [], 0, 0, [], [], 0
        out.write(HEADER.pack(MAGIC, bits, block, 0, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.ids))
        self.ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self.put(flat[k : k + self.block])
            self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.bytes)
        self.bytes += len(raw)
        self.out.write(raw)

    def close(self) -> None:
        if self.waiting:
            self.put(np.concatenate(self.rest))
        at = HEADER.size + self.bytes
        d = np.asarray(self.docs, dtype=[("id", "<i8"), ("null", "u1"), ("first", "<u8")])
        self.out.write(d.tobytes() + np.asarray(self.offsets, "<u8").tobytes())
        self.out.write(struct.pack("<QQQ", self.ids, len(d), at))


class Reader:
    """Reads documents or spans of one file; ``f`` is a seekable binary file."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(0)
        magic, self.bits, self.block, _, _ = HEADER.unpack(f.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        f.seek(size - 24)
        self.ids, n, at = struct.unpack("<QQQ", f.read(24))
        f.seek(at)
        self.docs = np.frombuffer(f.read(17 * n), dtype=[("id", "<i8"), ("null", "u1"), ("first", "<u8")])
        self.offsets = np.frombuffer(f.read(size - 24 - at - 17 * n), "<u8")
        self.end = at - HEADER.size

    def span(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n, of which only the blocks that hold them are read."""
        if not n:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (first + n - 1) // self.block
        stop = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
        self.f.seek(HEADER.size + int(self.offsets[a]))
        raw = np.frombuffer(self.f.read(stop - int(self.offsets[a])), np.uint8)
        out = []
        for k in range(a, b + 1):
            have = min(self.block, self.ids - k * self.block)
            out.append(unpack(raw[int(self.offsets[k] - self.offsets[a]) :][: (have * self.bits + 7) // 8], have, self.bits))
        return np.concatenate(out)[first - a * self.block :][:n]

    def document(self, k: int) -> tuple[int | None, int, np.ndarray]:
        """doc_id, first id in the file and ids of the k-th document."""
        d = self.docs[k]
        stop = int(self.docs[k + 1]["first"]) if k + 1 < len(self.docs) else self.ids
        return None if d["null"] else int(d["id"]), int(d["first"]), self.span(int(d["first"]), stop - int(d["first"]))

    def documents(self, at_once: int = READ_BLOCKS) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order, as ``document`` gives them. Blocks are read in order, ``at_once``
        of them by one read, and each only once; documents are cut out of them."""
        ends = [*self.docs["first"][1:].tolist(), self.ids][: len(self.docs)]
        k, start, pieces = 0, 0, []  # pieces hold the ids from start on that no document has yet

        def row(ids: np.ndarray) -> tuple[int | None, int, np.ndarray]:
            d = self.docs[k]
            return None if d["null"] else int(d["id"]), int(d["first"]), ids

        for low in range(0, self.ids, self.block * at_once):
            high = min(low + self.block * at_once, self.ids)
            pieces.append(self.span(low, high - low))
            if k < len(ends) and ends[k] <= high:
                flat = np.concatenate(pieces)
                while k < len(ends) and ends[k] <= high:
                    first = int(self.docs[k]["first"])
                    yield row(flat[first - start : ends[k] - start])
                    k += 1
                pieces, start = [flat[ends[k - 1] - start :]], ends[k - 1]
        while k < len(ends):  # without any id in the file
            yield row(np.zeros(0, np.uint32))
            k += 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Write the documents' ids in ascending doc_id order; the files: file (number), path, docs,
    ids. The result is itself written, so that reading it does not encode again."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or public_tokenizers.path(TOKENIZER)
    to = new_path(spark, "ids")
    vocabulary = encoder(path).lib.get_vocab_size(with_added_tokens=True)
    bits = max(1, int(max(vocabulary - 1, end_id)).bit_length())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task = encoder(path), TaskContext.get()
        system, folder = fs.FileSystem.from_uri(to)
        system.create_dir(folder)
        number = task.partitionId()
        name, own = (posixpath.join(folder, x) for x in (f"ids-{number:06d}.bin", f"_{number:06d}.{task.taskAttemptId()}"))
        writer = out = None
        for b in batches:
            if writer is None and len(b):
                out = system.open_output_stream(own)
                writer = Writer(out, bits, block)
            for d, text in zip(b.doc_id, b.text, strict=True):
                writer.add(None if pd.isna(d) else int(d), np.append(enc.ids(text), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            system.move(own, name)
            yield pd.DataFrame([(number, posixpath.join(to, posixpath.basename(name)), len(writer.docs), writer.ids)], columns=["file", "path", "docs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInPandas(run, "file int, path string, docs long, ids long"), "files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all files), n_tokens and ids_crc32 of
    every document in the files. There is a row for each file in ``files``, so that the sum over
    the files before is a window over few rows."""
    spark = files.sparkSession
    based = files.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, base in zip(b.path, b.base, strict=True):
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as f:
                    r, out = Reader(f, f.size()), []
                    for d, first, ids in r.documents():
                        out.append((d, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield frame(out)
                            out = []
                    yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return based.repartition(n, "file").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files and read every document back from them."""
    return read_files(write_files(docs, path, end_id))


def open_file(spark: SparkSession, path: str) -> Reader:
    """One file, for random access."""
    system, at = fs.FileSystem.from_uri(path)
    f = system.open_input_file(at)
    return Reader(f, f.size())
