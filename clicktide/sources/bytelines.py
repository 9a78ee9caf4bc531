"""Text files as lines that know where they stand: a data source over byte ranges.

    spark.dataSource.register(ByteLines)
    spark.read.format("bytelines").option("splitBytes", 1 << 27).load("hdfs:///logs/train")

gives `(file INT, offset LONG, value STRING)`: the number of a file among those under the path in
order of their names, and the byte at which the line begins. Both are the same for every split size
and cluster, so they name a line for as long as the files stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 1 << 27
# Bytes of a range that are looked at together.
CHUNK_BYTES = 1 << 23
# Bytes read at first behind a range, for the end of its last line.
TAIL_BYTES = 1 << 13
# Where ranges under SPLIT_BYTES would take more tasks than this, tasks read several of them.
TASKS = 1024

NEWLINE = 10


@dataclass
class Range:
    """Lines of a file that begin in bytes `start` to `end`; a compressed file is one range."""

    file: int
    path: str
    start: int
    end: int
    packed: bool


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def _is_packed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst", ".lz4"))


def listed(path: str) -> list[pafs.FileInfo]:
    """Files at or under `path`, by name; hidden ones and markers are left out."""
    files, place = _opened(path)
    top = files.get_file_info(place)
    if top.type == pafs.FileType.File:
        return [top]
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = files.get_file_info(pafs.FileSelector(place, recursive=True))
    base = len(top.path.rstrip("/")) + 1
    shown = lambda f: not any(p[:1] in "._" for p in f.path[base:].split("/"))
    return sorted((f for f in inside if f.type == pafs.FileType.File and shown(f)), key=lambda f: f.path)


def split(files: list[pafs.FileInfo], split_bytes: int) -> list[Ranges]:
    """Ranges of at most `split_bytes` each; small files share a partition, and so do small ranges
    of large files, up to SPLIT_BYTES."""
    parts, held, size = [], [], 0
    room = max(split_bytes, min(SPLIT_BYTES, -(-sum(f.size for f in files) // TASKS)))
    for number, f in enumerate(files):
        packed = _is_packed(f.path)
        for start in [0] if packed else range(0, f.size, split_bytes):
            end = f.size if packed else min(f.size, start + split_bytes)
            if held and size + end - start > room:
                parts.append(Ranges(held))
                held, size = [], 0
            held.append(Range(number, f.path, start, end, packed))
            size += end - start
    return parts + [Ranges(held)] if held else parts


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lines between `starts` and `ends` (their newlines) without a carriage return at the end."""
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 13))
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    keep = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(keep)]
    lines = pa.Array.from_buffers(pa.binary(), len(sizes), buffers)
    try:
        return lines.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 are replaced
        return pa.array([v.decode("utf-8", "replace") for v in lines.to_pylist()], pa.string())


def lines_of(stream, part: Range) -> Iterator[pa.RecordBatch]:
    """`(file, offset, value)` of the lines that begin in a range, a chunk at a time."""
    place, rest, done = part.start, b"", False
    if part.start:
        # The line that the range begins in belongs to the range before, unless it begins here.
        stream.seek(part.start - 1)
        place -= 1
    skip = part.start > 0
    while not done:
        # A range is read no further than its last line; a line that goes on takes twice as much each time.
        left = CHUNK_BYTES if part.packed else part.end - place - len(rest)
        new = stream.read(min(CHUNK_BYTES, max(left, len(rest), TAIL_BYTES)))
        data = rest + new
        done = not new
        if skip:
            cut = data.find(b"\n") + 1
            if not cut:
                if done or place + len(data) >= part.end and not part.packed:
                    return
                place, rest = place + len(data), b""
                continue
            place, data, skip = place + cut, data[cut:], False
        if not part.packed and place >= part.end:
            return
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == NEWLINE)
        if done and len(raw) and raw[-1] != NEWLINE:
            ends = np.append(ends, len(raw))
        starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
        if not part.packed:
            own = starts + place < part.end
            starts, ends = starts[own], ends[own]
            done |= not own.all()
        if len(starts):
            arrays = [
                pa.array(np.full(len(starts), part.file, np.int32)), pa.array(starts + place), _strings(raw, starts, ends)
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "offset", "value"])
            used = int(ends[-1]) + 1
            place, rest = place + used, data[used:]
        else:
            rest = data


class ByteLinesReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        if split_bytes < 1:
            raise ValueError("splitBytes must be positive")
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Ranges]:
        return split(listed(self.path), self.split_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        for path, parts in groupby(partition.ranges, lambda part: part.path):
            parts = list(parts)
            opened = files.open_input_stream(path) if parts[0].packed else files.open_input_file(path)
            with opened as stream:
                for part in parts:
                    if not part.start and not part.packed:
                        stream.seek(0)
                    yield from lines_of(stream, part)


class ByteLines(DataSource):
    """Options: `path`, and `splitBytes`, by default 128 MB."""

    @classmethod
    def name(cls) -> str:
        return "bytelines"

    def schema(self) -> str:
        return "file INT, offset LONG, value STRING"

    def reader(self, schema) -> ByteLinesReader:
        return ByteLinesReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))
