"""Lines of compressed text in parallel, as a Spark data source.

A block-gzipped file is a row of small gzip members, each of which tells its own length. A split
of such a file is a range of bytes: it gives the blocks that begin in it, and the lines that
begin in those, so that any cut into splits gives each line once. Other gzipped files are one
split. Files are read by pyarrow's file systems (local and shared folders, and the stores that
they know), in pieces of bounded size.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 32 << 20
PIECE = 4 << 20
#: How a member of a block-gzipped file begins, and its longest length.
MAGIC, LONGEST = b"\x1f\x8b\x08\x04", 1 << 16


def system(path: str) -> tuple[fs.FileSystem, str]:
    if ":/" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def files(path: str) -> list[tuple[str, int]]:
    """Each file at the path and its size: itself, or those of a folder by name, hidden ones left out."""
    store, at = system(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.Directory:
        some = [x for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    else:
        some = [found]
    head = path[: path.index(":/") + 1] if ":/" in path else ""
    host = path[len(head) + 2 :].split("/", 1)[0] if path[len(head) : len(head) + 2] == "//" else None
    root = f"{head}//{host}" if host is not None else head
    return [(f"{root}{x.path}", x.size) for x in sorted(some, key=lambda x: x.path)]


def block_size(data: bytes, at: int) -> int:
    """Length of the block whose header is at this place; 0 if there is none."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return 0
    k, end = at + 12, at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    while k + 4 <= end <= len(data):
        length = int.from_bytes(data[k + 2 : k + 4], "little")
        if data[k : k + 2] == b"BC" and length == 2:
            return int.from_bytes(data[k + 4 : k + 6], "little") + 1
        k += 4 + length
    return 0


def blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of each block from the first that begins at or after ``at``."""
    file.seek(at)
    data, found = b"", at == 0
    while True:
        more = file.read(PIECE)
        data += more
        k = 0
        while True:
            if not found:  # bytes that only look like a header don't inflate to their checksum
                k = data.find(MAGIC, k)
                if k < 0 or len(data) - k < LONGEST and more:
                    k = max(len(data) - 3, 0) if k < 0 else k
                    break
            size = block_size(data, k)
            if size and len(data) - k < size and more:
                break
            try:
                text = zlib.decompress(data[k : k + size], 31) if size else None
            except zlib.error:
                text = None
            if text is None:
                if found:
                    if k < len(data) and not (more and len(data) - k < LONGEST):
                        raise ValueError(f"no block at {at + k}")
                    break
                k += 1
                continue
            found = True
            yield at + k, text
            k += size
        at, data = at + k, data[k:]
        if not more:
            return


def split_text(file, low: int, high: int) -> Iterator[bytes]:
    """The text of the lines that begin in blocks that begin in [low, high): what stands before the
    first line's end is left to the split before, which reads on to there."""
    began = low == 0
    for at, text in blocks(file, low):
        if at >= high:
            if not began:  # no line ends in this split, so none begins
                return
            end = text.find(b"\n") + 1
            yield text[:end] if end else text
            if end:
                return
            continue
        if not began:
            end = text.find(b"\n") + 1
            if not end:
                continue
            began, text = True, text[end:]
        yield text


def whole_text(file) -> Iterator[bytes]:
    """Text of a file, gzipped in any number of members or plain."""
    data = file.read(PIECE)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = file.read(PIECE)
        return
    member = zlib.decompressobj(31)
    while data:
        yield member.decompress(data)
        if member.eof:
            data, member = member.unused_data, zlib.decompressobj(31)
            data = data or file.read(PIECE)
        else:
            data = file.read(PIECE)


def lines(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Whole lines, some megabytes at a time."""
    rest: list[bytes] = []
    held = 0
    for text in texts:
        rest.append(text)
        held += len(text)
        if held >= PIECE and b"\n" in text:
            *some, last = b"".join(rest).split(b"\n")
            yield some
            rest, held = [last], len(last)
    some = b"".join(rest).split(b"\n")
    yield some[:-1] if some[-1] == b"" else some


def first_lines(path: str, last: bytes) -> list[str]:
    """Lines from the beginning up to the one that begins with ``last``, or all that begin as a
    header's; no more than they need is read."""
    out: list[str] = []
    for name, _ in files(path):
        store, at = system(name)
        with store.open_input_file(at) as file:
            text = b""
            for piece in whole_text(_Pieces(file)):
                *done, text = (text + piece).split(b"\n")
                for x in done:
                    if not x.startswith(b"#"):
                        return out
                    out.append(x.decode())
                    if x.startswith(last):
                        return out
            if text.startswith(b"#"):
                out.append(text.decode())
    return out


class _Pieces:
    """A file that gives little at a time."""

    def __init__(self, file) -> None:
        self.file = file

    def read(self, _: int) -> bytes:
        return self.file.read(LONGEST)


def pruned(line: bytes, tag: bytes) -> bytes:
    """A record with that one tag of its samples; where it is absent, as it is."""
    f = line.split(b"\t")
    tags = f[8].split(b":") if len(f) > 9 else []
    if len(tags) < 2 or tag not in tags:
        return line
    k = tags.index(tag)
    f[8] = tag
    f[9:] = [x[k] if len(x) > k else b"." for x in (c.split(b":") for c in f[9:])]
    return b"\t".join(f)


class Split(InputPartition):
    def __init__(self, path: str, low: int, high: int, blocked: bool) -> None:
        self.path, self.low, self.high, self.blocked = path, low, high, blocked


class LinesReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.tag = options["path"], options.get("tag", "").encode()
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, size in files(self.path):
            store, at = system(name)
            with store.open_input_file(at) as file:
                blocked = block_size(file.read(LONGEST), 0) > 0
            step = self.split if blocked else max(size, 1)
            out += [Split(name, low, min(low + step, size), blocked) for low in range(0, size, step)]
        return out or [Split("", 0, 0, False)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        store, at = system(split.path)
        with store.open_input_file(at) as file:
            for some in lines(split_text(file, split.low, split.high) if split.blocked else whole_text(file)):
                if self.tag:
                    some = [pruned(x, self.tag) if not x.startswith(b"#") else x for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string())], ["value"])


class Lines(DataSource):
    """Options: path; tag: the one FORMAT tag that samples keep; split: bytes."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def read_lines(spark: SparkSession, path: str, tag: str = "", split: int = SPLIT) -> DataFrame:
    """A row for each line, as column value."""
    spark.dataSource.register(Lines)
    return spark.read.format(Lines.name()).option("path", path).option("tag", tag).option("split", split).load()
