"""A stream of the lines that log files have grown by.

The offset of the stream is the number of a scan. What a scan covers is a table of its own, in the folder ``state``: for each
file the bytes from and to, written by the task that looks after the file before it reads a line. A batch that is run again
finds that table and reads the same bytes. No list of files passes through the driver: files are dealt to tasks by a hash of
the entry of the root they lie below, and each task lists the folders of its own entries only.

Only lines that are complete are read; a file that became shorter, or begins differently, is read from its start. Roots and
``state`` must be reachable from the tasks by the path given (a mounted folder, or an address that pyarrow can open).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file_path string, block_start bigint, line_id bigint, modified timestamp"
BLOCK_BYTES, HEAD_BYTES, BATCH_LINES = 1 << 20, 256, 4096
SKIPPED = "subagents"


def _open(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


@dataclass
class Shard(InputPartition):
    """The files of a root that one task looks after, between two scans."""

    start: int
    end: int
    number: int


def _logs(files: fs.FileSystem, root: str, number: int, shards: int, suffix: str) -> Iterator[fs.FileInfo]:
    """The logs below those entries of a root that belong to a shard."""
    def found(info):
        if info.type == fs.FileType.File and info.path.endswith(suffix) and SKIPPED not in info.path.split("/"):
            yield info

    for entry in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if int(hashlib.md5(entry.path.encode()).hexdigest()[:8], 16) % shards != number:
            continue
        if entry.type == fs.FileType.File:
            yield from found(entry)
        elif entry.type == fs.FileType.Directory:
            for info in files.get_file_info(fs.FileSelector(entry.path, recursive=True)):
                yield from found(info)


def _head(file: pa.NativeFile, size: int) -> str:
    return hashlib.sha256(file.read_at(min(size, HEAD_BYTES), 0)).hexdigest()


def _last_line_end(file: pa.NativeFile, low: int, high: int) -> int:
    """Where the last complete line between two places ends."""
    while high > low:
        at = max(low, high - BLOCK_BYTES)
        found = file.read_at(high - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


def covered(files: fs.FileSystem, info: fs.FileInfo, before: dict | None) -> dict:
    """What a scan covers of a file: the bytes from and to, and a digest of its first bytes to know it again."""
    with files.open_input_file(info.path) as file:
        size = file.size()
        start = before["to"] if before else 0
        if before and (size < start or _head(file, before["head_bytes"]) != before["head"]):
            start = 0
        stop = _last_line_end(file, start, size)
        known = min(stop, HEAD_BYTES)
        return {"path": info.path, "from": start, "to": stop, "head": _head(file, known), "head_bytes": known, "modified": info.mtime_ns // 1000}


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.state = json.loads(options["roots"]), options["state"].rstrip("/")
        self.shards, self.suffix = int(options.get("shards", "64")), options.get("suffix", ".jsonl")

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        """The scan after the last one that has begun to cover files."""
        files, path = _open(self.state)
        done = [int(e.base_name) for e in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if e.base_name.isdigit()]
        return {"scan": max(done, default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(start["scan"], end["scan"], n) for n in range(self.shards)]

    def commit(self, end: dict) -> None:
        """Scans before the one that a next batch starts from are not needed again."""
        files, path = _open(self.state)
        for entry in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if entry.base_name.isdigit() and int(entry.base_name) < end["scan"] - 1:
                files.delete_dir(entry.path)

    def _load(self, scan: int, number: int) -> dict[str, dict] | None:
        files, path = _open(f"{self.state}/{scan}/{number}.json")
        if files.get_file_info(path).type != fs.FileType.File:
            return None
        with files.open_input_stream(path) as stream:
            return {row["path"]: row for row in map(json.loads, stream.read().splitlines())}

    def _save(self, scan: int, number: int, rows: list[dict]) -> None:
        files, path = _open(f"{self.state}/{scan}/{number}.json")
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(f"{path}.new") as stream:
            stream.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        files.move(f"{path}.new", path)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        now = self._load(partition.end, partition.number)
        if now is None:
            before = (self._load(partition.start, partition.number) if partition.start else None) or {}
            now = {}
            for root in self.roots:
                files, path = _open(root)
                for info in _logs(files, path, partition.number, self.shards, self.suffix):
                    now[info.path] = covered(files, info, before.get(info.path)) | {"root": root}
            self._save(partition.end, partition.number, list(now.values()))
        for row in now.values():
            if row["to"] > row["from"]:
                yield from self._lines(row)

    def _lines(self, row: dict) -> Iterator[pa.RecordBatch]:
        """The lines of a file between two ends of lines, a block at a time; a line is numbered by its first byte."""
        files, _ = _open(row["root"])
        scheme = row["root"].split("://")[0] + "://" if "://" in row["root"] else ""
        with files.open_input_file(row["path"]) as file:
            at, rest, held, starts = row["from"], b"", [], []
            while at < row["to"]:
                block = file.read_at(min(BLOCK_BYTES, row["to"] - at), at)
                if not block:
                    break
                first = at - len(rest)
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    held.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    starts.append(first)
                    first += len(line) + 1
                if len(held) >= BATCH_LINES:
                    yield self._batch(held, starts, scheme + row["path"], row["modified"])
                    held, starts = [], []
            if held:
                yield self._batch(held, starts, scheme + row["path"], row["modified"])

    @staticmethod
    def _batch(lines: list[str], starts: list[int], path: str, modified: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(lines, pa.string()), pa.array([path] * len(lines)), pa.array([0] * len(lines), pa.int64()), pa.array(starts, pa.int64()),
             pa.array([modified] * len(lines), pa.timestamp("us", "UTC"))], names=["value", "file_path", "block_start", "line_id", "modified"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, roots: list[str], state: str, shards: int = 64, suffix: str = ".jsonl") -> DataFrame:
    """A stream of new lines below the roots, in the columns ``extract_messages`` expects.

    ``line_id`` is the place of a line's first byte in its file. ``state`` belongs to one stream and lives as long as its
    checkpoint. Every trigger is one scan.
    """
    spark.dataSource.register(TailSource)
    options = {"roots": json.dumps(sorted({r.rstrip("/") for r in roots})), "state": state, "shards": str(shards), "suffix": suffix}
    return spark.readStream.format("log_tail").options(**options).load()
