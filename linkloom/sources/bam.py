"""Paired alignments of BAM files as a Spark data source: `spark.read.format("bam").load(path)`.

A file is cut into byte ranges; each task finds the first block of compressed data in its range,
then the first plausible record, and reads on to the end of its range. Only the six columns that
links need are decoded. With the option `header` the references of each file are given instead.
Files are opened by path, so the executors must have them under the same path (a shared mount).
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ref string, pos bigint, mapq int, flag int, mate_ref string, mate_pos bigint, file string"
HEADER_SCHEMA = "contig string, length bigint, file string"
SPLIT = 64 << 20
ROWS = 50_000


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the compressed blocks from `at` on."""
    while at < size:
        f.seek(at)
        head = f.read(18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block at {at}")
        length = struct.unpack_from("<H", head, 16)[0] + 1
        f.seek(at + 18)
        body = f.read(length - 18)
        yield at, zlib.decompress(body[:-8], -15)
        at += length


def first_block(f, at: int, size: int) -> int:
    """The first place from `at` on where a block begins that is followed by another one or the end."""
    if at == 0:
        return 0
    f.seek(at)
    data = f.read(1 << 17)
    i = data.find(b"\x1f\x8b\x08\x04")
    while i >= 0:
        if i + 18 <= len(data) and data[i + 10 : i + 16] == b"\x06\x00BC\x02\x00":
            nxt = at + i + struct.unpack_from("<H", data, i + 16)[0] + 1
            f.seek(nxt)
            if nxt == size or f.read(4) == b"\x1f\x8b\x08\x04":
                return at + i
        i = data.find(b"\x1f\x8b\x08\x04", i + 1)
    return size


def header(f, size: int) -> tuple[list[tuple[str, int]], int, int]:
    """References, and where the records begin: place of a block and offset in its content."""
    data, places = b"", []
    for at, content in blocks(f, 0, size):
        places.append((at, len(data)))
        data += content
        if len(data) < 12:
            continue
        n_text = struct.unpack_from("<i", data, 4)[0]
        if len(data) < 12 + n_text:
            continue
        n_ref, i, refs = struct.unpack_from("<i", data, 8 + n_text)[0], 12 + n_text, []
        try:
            for _ in range(n_ref):
                n = struct.unpack_from("<i", data, i)[0]
                refs.append((data[i + 4 : i + 3 + n].decode(), struct.unpack_from("<i", data, i + 4 + n)[0]))
                i += 8 + n
        except struct.error:
            continue
        if i <= len(data):
            block, before = next(p for p in reversed(places) if p[1] <= i)
            return refs, block, i - before
    raise ValueError("no whole header")


def plausible(data: bytes, i: int, n_ref: int) -> bool:
    """Whether a record may begin at i, with another one after it unless the data ends first."""
    for _ in range(3):
        if i + 36 > len(data):
            return i == len(data) or i + 4 > len(data)
        n, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, i)
        least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq if l_seq >= 0 else 1 << 40
        if not (-1 <= ref < n_ref and -1 <= mate < n_ref and pos >= -1 and mate_pos >= -1 and l_name > 0 and least <= n < 1 << 28):
            return False
        name_end = i + 36 + l_name - 1
        if name_end < len(data) and data[name_end] != 0:
            return False
        i += 4 + n
        if i >= len(data):
            return True
    return True


def files(path: str) -> list[str]:
    local = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(local, "*.bam")) if os.path.isdir(local) else glob.glob(local))
    if not found:
        raise FileNotFoundError(path)
    return found


class BamHeaderReader(DataSourceReader):
    """The references of each file, a task a file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Range(p, 0, 0) for p in files(self.path)]

    def read(self, part: Range) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            for name, length in header(f, os.path.getsize(part.path))[0]:
                yield name, length, part.path


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return [Range(p, a, a + self.split) for p in files(self.path) for a in range(0, max(1, os.path.getsize(p)), self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        size = os.path.getsize(part.path)
        with open(part.path, "rb") as f:
            refs, block, offset = header(f, size)
            names = [n for n, _ in refs]
            at = first_block(f, part.start, size)
            if at >= min(part.end, size):
                return
            source, data, i = blocks(f, at if at > block else block, size), b"", -1
            if at <= block:
                if block >= part.end:
                    return
                i = offset
            rows: list[tuple] = []
            limit = None  # bytes of data that begin before the end of the range
            for place, content in source:
                if place >= part.end and limit is None:
                    limit = len(data)
                data += content
                if i < 0:
                    i = next((k for k in range(min(len(data), 1 << 16)) if plausible(data, k, len(names))), -1)
                    if i < 0:
                        continue
                while i + 4 <= len(data) and (limit is None or i < limit):
                    n = struct.unpack_from("<i", data, i)[0]
                    if i + 4 + n > len(data):
                        break
                    ref, pos, _, mapq, _, _, flag, _, mate, mate_pos = struct.unpack_from("<iiBBHHHiii", data, i + 4)
                    rows.append((names[ref] if ref >= 0 else None, pos, mapq, flag, names[mate] if mate >= 0 else None, mate_pos, part.path))
                    i += 4 + n
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
                if limit is not None and i >= limit:
                    break
                data, limit, i = data[i:], None if limit is None else limit - i, 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()]
    names = ["ref", "pos", "mapq", "flag", "mate_ref", "mate_pos", "file"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def _only_header(self) -> bool:
        return str(self.options.get("header", "false")).lower() == "true"

    def schema(self) -> str:
        return HEADER_SCHEMA if self._only_header() else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if self._only_header():
            return BamHeaderReader(self.options["path"])
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark) -> None:
    spark.dataSource.register(BamSource)
