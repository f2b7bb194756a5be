"""A directory tree as a table: path, mode, mtime_unix, content.

Regular files and links to them are read, hidden and empty ones too; anything else, and what can't be
read, is a row of the option ``errors`` (path, reason). The driver lists only the upper directories until
there are enough of them; executors list what is below and read the contents, so the tree has to be on
storage that all of them mount. A large directory is dealt out by its names' checksums.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, mode int, mtime_unix long, content binary"
ERRORS = "path string, reason string"
DIRECTORIES, NAMES_A_PART = 64, 256
_BATCH_BYTES, _BATCH_FILES = 32 << 20, 256
_KINDS = pa.schema([("path", pa.string()), ("mode", pa.int32()), ("mtime_unix", pa.int64()), ("content", pa.binary())])
Found = tuple[str, str]  # relative path, and why it is left out, or nothing


@dataclass
class _Part(InputPartition):
    """A directory, whole or only its own entries, and of these the names of one remainder."""

    folder: str
    deep: bool
    part: int = 0
    of: int = 1


def _relative(root: str, full: str) -> str:
    return os.path.relpath(full, root).replace(os.sep, "/")


def _entries(root: str, folder: str) -> tuple[list[str], list[Found]]:
    """Directories in a directory, and its other entries."""
    folders, found = [], []
    try:
        names = sorted(os.listdir(folder), key=os.fsencode)
    except OSError:
        return [], [(_relative(root, folder), "unreadable directory")]
    for name in names:
        full = os.path.join(folder, name)
        try:
            mode = os.stat(full).st_mode
        except OSError:
            mode = 0
        if stat.S_ISDIR(mode):
            if os.path.islink(full):
                found.append((_relative(root, full), "link to a directory"))
            else:
                folders.append(full)
        elif not stat.S_ISREG(mode):
            found.append((_relative(root, full), "not a regular file"))
        else:
            found.append((_relative(root, full), "" if os.access(full, os.R_OK) else "unreadable"))
    return folders, found


def _below(root: str, part: _Part) -> Iterator[Found]:
    open_ = [part.folder]
    while open_:
        folders, found = _entries(root, open_.pop())
        for path, reason in found:
            if part.of == 1 or zlib.crc32(os.fsencode(path)) % part.of == part.part:
                yield path, reason
        if part.deep:
            open_ += folders


def walk(root: str) -> tuple[list[str], list[Found]]:
    """Relative paths of files in byte order, and (path, reason) of what is left out."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such directory: {root}")
    found = list(_below(root, _Part(root, True)))
    return sorted((path for path, reason in found if not reason), key=os.fsencode), sorted(x for x in found if x[1])


class _Reader(DataSourceReader):
    def __init__(self, root: str, errors: bool):
        self.root, self.errors = root, errors

    def partitions(self) -> list[InputPartition]:
        open_, parts = [self.root], []
        while open_ and len(open_) < DIRECTORIES:  # one level after the other
            level, open_ = open_, []
            for folder in level:
                folders, found = _entries(self.root, folder)
                open_ += folders
                of = -(-len(found) // NAMES_A_PART)
                parts += [_Part(folder, False, k, of) for k in range(of)]
        return parts + [_Part(folder, True) for folder in open_] or [_Part(self.root, False)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, reason in _below(self.root, partition):
            if self.errors:
                if reason:
                    yield pa.RecordBatch.from_pydict({"path": [path], "reason": [reason]})
                continue
            if reason:
                continue
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content, (mode, mtime) = f.read(), _stat(f.fileno())
            except OSError:  # gone or closed to us since it was listed
                continue
            rows.append({"path": path, "mode": mode, "mtime_unix": mtime, "content": content})
            size += len(content)
            if size >= _BATCH_BYTES or len(rows) >= _BATCH_FILES:
                yield pa.RecordBatch.from_pylist(rows, _KINDS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _KINDS)


def _stat(handle: int) -> tuple[int, int]:
    """Mode and time of an open file; zeros where they can't be had."""
    try:
        info = os.fstat(handle)
    except OSError:
        return 0, 0
    return info.st_mode, int(info.st_mtime)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def _errors(self) -> bool:
        return self.options.get("errors", "false").lower() == "true"

    def schema(self) -> str:
        return ERRORS if self._errors() else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._errors())


def _source(spark: SparkSession, root: str, errors: str) -> DataFrame:
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such directory: {root}")
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("errors", errors).load(root)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    return _source(spark, root, "false")


def read_errors(spark: SparkSession, root: str) -> DataFrame:
    """path and reason of what ``read_tree`` leaves out."""
    return _source(spark, root, "true")


def write_tree(restored: DataFrame, target: str) -> None:
    """Write verified files (path, mode, mtime_unix, content) below ``target``, from the executors."""
    root = os.path.abspath(target)

    def run(rows) -> None:
        for r in rows:
            full = os.path.abspath(os.path.join(root, r["path"]))
            if os.path.isabs(r["path"]) or not full.startswith(root + os.sep):
                raise ValueError(f"the path leaves the target: {r['path']}")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as f:
                f.write(r["content"])
            os.chmod(full, r["mode"] & 0o7777)
            os.utime(full, (r["mtime_unix"], r["mtime_unix"]))

    os.makedirs(root, exist_ok=True)
    restored.select("path", "mode", "mtime_unix", "content").foreachPartition(run)
