"""Tail of a folder of transcripts: a stream source that reads the lines appended to files it already knows.

An offset holds, for each file, the byte after its last complete line and its size. Only ranges between two offsets are read, so
a micro-batch costs what was appended, and a batch that is run again after a failure reads the same bytes. A line without
its newline stays unread until it is complete. A file that became shorter is read again from its start; one that goes is
forgotten, and read from its start if it comes back. Long ranges are read by several tasks, each the lines that begin in its part.

Paths are opened through pyarrow's file systems (local, ``hdfs://``, ``s3://`` and others), on the driver for
listing and on executors for reading. The offset grows with the number of files, not with their bytes.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, session string, position long, value string"
ARROW = pa.schema([("path", pa.string()), ("session", pa.string()), ("position", pa.int64()), ("value", pa.string())])
BLOCK, SPLIT, BATCH_LINES, BATCH_BYTES = 1 << 16, 32 << 20, 1000, 4 << 20


@dataclass
class Part(InputPartition):
    """Bytes ``begin`` to ``end`` of a file, of which the lines that begin in ``low`` to ``high`` are read."""

    path: str
    begin: int
    end: int
    low: int
    high: int


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def after_last_newline(store: fs.FileSystem, path: str, size: int, floor: int) -> int:
    """The byte after the last newline in the first ``size`` bytes, looked for backwards down to ``floor``; ``floor`` without one."""
    with store.open_input_file(path) as f:
        high = size
        while high > floor:
            low = max(floor, high - BLOCK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return floor


def lines_of(store: fs.FileSystem, part: Part) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the part's lines. A part that begins inside the range looks one byte back for its first line."""
    skip = part.low > part.begin
    at = part.low - skip
    with store.open_input_file(part.path) as f:
        f.seek(at)
        rest = b""
        while at < part.high:
            block = f.read(min(BLOCK * 16, part.end - at - len(rest)))
            if not block:
                return
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if at >= part.high:
                    return
                if not skip:
                    yield at, line
                skip = False
                at += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.glob, self.split = options["path"], options.get("glob", "*.jsonl"), int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, root = file_system(self.root)
        files = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type != fs.FileType.File or not fnmatch.fnmatch(f.base_name, self.glob):
                continue
            position, size = self.known.get(f.path, [0, 0])
            if f.size != size:
                try:
                    position = after_last_newline(store, f.path, f.size, position if f.size > size else 0)
                except FileNotFoundError:
                    continue
            files[f.path] = [position, f.size]
        self.known = files
        return {"files": dict(sorted(files.items()))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for path, (position, size) in end["files"].items():
            begin, before = start["files"].get(path, [0, 0])
            if size < before or position < begin:
                begin = 0
            for low in range(begin, position, self.split):
                out.append(Part(path, begin, position, low, min(position, low + self.split)))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.root)
        session = part.path.rsplit("/", 1)[-1].removesuffix(".jsonl")
        at: list[int] = []
        values: list[str] = []
        held = 0

        def batch() -> pa.RecordBatch:
            n = len(at)
            return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([session] * n), pa.array(at, pa.int64()), pa.array(values, pa.string())], schema=ARROW)

        try:
            for position, line in lines_of(store, part):
                text = line.decode("utf-8", "replace")
                if not text.strip():
                    continue
                at.append(position)
                values.append(text)
                held += len(line)
                if len(at) >= BATCH_LINES or held >= BATCH_BYTES:
                    yield batch()
                    at, values, held = [], [], 0
        except FileNotFoundError:  # gone since it was listed, as a watcher takes it
            pass
        if at:
            yield batch()

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch once it is done; the checkpoint has its offset."""


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").load(folder)``; options ``glob`` and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
