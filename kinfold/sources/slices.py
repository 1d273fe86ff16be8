"""Binary likelihoods of samples in records of fixed width: three doubles for each sample.

Reading keeps the first samples of each record. Plain files are cut at record borders; a gzipped
one is one split, read in pieces. Writing gives gzip members in the order of the records, which
can be joined into one file as they are; only parts of tasks that are committed stay.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kinfold.sources import lines

VALUES = 3  # of a sample
SPLIT = 64 << 20


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int, first: int) -> None:
        self.path, self.low, self.high, self.first = path, low, high, first


class SliceReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.total, self.keep = options["path"], int(options["total"]), int(options["keep"])
        self.split = int(options.get("split", SPLIT))
        if not 0 < self.keep <= self.total:
            raise ValueError("samples to keep: from 1 to all")

    def partitions(self) -> list[InputPartition]:
        out, width = [], self.total * VALUES * 8
        found = lines.files(self.path)
        if len(found) > 1 and any(n.endswith(".gz") for n, _ in found):
            raise ValueError("the records of more than one gzipped file can't be numbered: join them first")
        first = 0
        for name, size in found:
            if name.endswith(".gz"):
                out.append(Range(name, 0, -1, first))
                continue
            if size % width:
                raise ValueError(f"{name} ends within a record")
            step = max(self.split // width, 1) * width
            out += [Range(name, low, min(low + step, size), first + low // width) for low in range(0, size, step)]
            first += size // width
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        width, record = self.total * VALUES * 8, part.first
        store, at = lines.system(part.path)
        with store.open_input_file(at) as file:
            file.seek(part.low)
            pieces = lines.whole_text(file) if part.high < 0 else iter(lambda: file.read(min(lines.PIECE, part.high - file.tell())), b"")
            rest = b""
            for piece in pieces:
                rest += piece
                n = len(rest) // width
                if n:
                    kept = np.frombuffer(rest[: n * width], "<f8").reshape(n, -1)[:, : self.keep * VALUES]
                    flat = pa.array(np.ascontiguousarray(kept).ravel())
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (self.keep * VALUES))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(record, record + n)), pa.ListArray.from_arrays(offsets, flat)], ["record", "values"])
                    record, rest = record + n, rest[n * width :]
            if rest:
                raise ValueError(f"{part.path} ends within a record")


@dataclass
class Written(WriterCommitMessage):
    path: str
    name: str


class SliceWriter(DataSourceWriter):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def write(self, rows) -> Written:
        context = TaskContext.get()
        store, at = lines.system(self.path)
        store.create_dir(at)
        part = os.path.join(at, f"_{context.partitionId():05d}-{context.taskAttemptId()}")
        with store.open_output_stream(part, compression=None) as out, gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as packed:
            for r in rows:
                packed.write(np.asarray(r[1], "<f8").tobytes())
        return Written(part, os.path.join(at, f"part-{context.partitionId():05d}.gz"))

    def commit(self, messages) -> None:
        store, _ = lines.system(self.path)
        for m in messages:
            if m:
                store.move(m.path, m.name)

    def abort(self, messages) -> None:
        store, _ = lines.system(self.path)
        for m in messages:
            if m:
                store.delete_file(m.path)


class Slices(DataSource):
    """Options: path; for reading total and keep, samples in a record and those to keep."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_slices"

    def schema(self) -> str:
        return "record long, values array<double>"

    def reader(self, schema) -> SliceReader:
        return SliceReader(self.options)

    def writer(self, schema, overwrite: bool) -> SliceWriter:
        return SliceWriter(self.options)


def read_slices(spark: SparkSession, path: str, total: int, keep: int, split: int = SPLIT) -> DataFrame:
    """record (its place) and values: those of the first ``keep`` of ``total`` samples."""
    spark.dataSource.register(Slices)
    return spark.read.format(Slices.name()).option("path", path).option("total", total).option("keep", keep).option("split", split).load()


def write_slices(rows: DataFrame, path: str) -> None:
    """rows: record, values. Into a folder, in the order of the records."""
    rows.sparkSession.dataSource.register(Slices)
    rows.select("record", "values").repartitionByRange("record").sortWithinPartitions("record").write.format(Slices.name()).option("path", path).mode("append").save()
