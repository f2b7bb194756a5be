"""Binary formats of a repository: write-ahead log, manifest and repository metadata.

The log's frames have one size, so numpy reads many at a time; manifests have variable entries and
are decoded one by one. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.columns import le_bytes

#: Fixed values of the formats.
META_MAGIC, MANIFEST_MAGIC, VERSION = b"DEDUPBK1", b"DEDUPMF1", 1
WAL_BODY, WAL_TYPE, WAL_FRAME = 45, 1, 53
WAL_SLICE = 1 << 16  # frames that are read at a time
ID_MOST, PATH_MOST = 15, 0xFFFF
_META = struct.Struct("<8sIIIIQ")
_HEAD = struct.Struct("<8sI16sqQ")
_ENTRY = struct.Struct("<IQq32sI")
_WAL = np.dtype([("size", "<u4"), ("type", "u1"), ("digest", "u1", 32), ("offset", "<u8"), ("length", "<u4"), ("crc", "<u4")])
_HEX = np.frombuffer(bytes(range(256)).hex().encode(), np.uint8).reshape(256, 2)


class FormatError(ValueError):
    """A file isn't what its format says."""


def encode_meta(min_size: int, avg_size: int, max_size: int, gear_seed: int) -> bytes:
    return _META.pack(META_MAGIC, VERSION, min_size, avg_size, max_size, gear_seed)


def decode_meta(raw: bytes) -> dict:
    if len(raw) != _META.size:
        raise FormatError("repository metadata has a wrong size")
    magic, version, least, avg, most, seed = _META.unpack(raw)
    if (magic, version) != (META_MAGIC, VERSION):
        raise FormatError("repository metadata has a wrong magic or version")
    return {"min_size": least, "avg_size": avg, "max_size": most, "gear_seed": seed}


def encode_manifest(snapshot_id: str, created_unix: int, files: Iterable[dict]) -> bytes:
    """A manifest's bytes, entries in byte order of their paths."""
    name = snapshot_id.encode()
    if len(name) > ID_MOST:
        raise FormatError(f"snapshot ids have at most {ID_MOST} bytes")
    entries = sorted(files, key=lambda f: f["path"].encode())
    out = [_HEAD.pack(MANIFEST_MAGIC, VERSION, name, created_unix, len(entries))]
    for f in entries:
        path = f["path"].encode()
        if len(path) > PATH_MOST:
            raise FormatError(f"paths have at most {PATH_MOST} bytes")
        digests = [bytes.fromhex(d) for d in f["chunk_digests"]]
        out += [struct.pack("<H", len(path)), path, _ENTRY.pack(f["mode"], f["size"], f["mtime_unix"], bytes.fromhex(f["file_digest"]), len(digests)), *digests]
    return b"".join(out)


def decode_manifest(raw: bytes) -> dict:
    """A manifest's id, time and entries; raises FormatError on any fault."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise FormatError("the manifest is cut short")
        at += n
        return raw[at - n : at]

    magic, version, name, created, count = _HEAD.unpack(take(_HEAD.size))
    if (magic, version) != (MANIFEST_MAGIC, VERSION):
        raise FormatError("the manifest has a wrong magic or version")
    files = []
    for _ in range(count):
        path = take(struct.unpack("<H", take(2))[0]).decode()
        mode, size, mtime, digest, n = _ENTRY.unpack(take(_ENTRY.size))
        files.append({"path": path, "mode": mode, "size": size, "mtime_unix": mtime, "file_digest": digest.hex(), "chunk_digests": [take(32).hex() for _ in range(n)]})
    if at != len(raw):
        raise FormatError("bytes follow the manifest's last entry")
    return {"snapshot_id": name.rstrip(b"\0").decode(), "created_unix": created, "files": files}


def write_manifests(manifests: DataFrame, created_unix: int = 0) -> DataFrame:
    """snapshot_id and content, the binary manifest, of every snapshot: one file each, as the format has it."""
    entry = ("path", "mode", "size", "mtime_unix", "file_digest", "chunk_digests")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw = [encode_manifest(i, created_unix, files.as_py()) for i, files in zip(ids, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["snapshot_id", "content"])

    return manifests.groupBy("snapshot_id").agg(F.collect_list(F.struct(*entry)).alias("files")).mapInArrow(run, "snapshot_id string, content binary")


MANIFEST_ROWS = "snapshot_id string, path string, mode long, size long, mtime_unix long, file_digest string, chunk_digests array<string>"


def read_manifests(files: DataFrame) -> DataFrame:
    """Entries of manifests in the ``content`` column."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                m = decode_manifest(raw.as_py())
                rows = [{"snapshot_id": m["snapshot_id"], **f} for f in m["files"]]
                kinds = [("snapshot_id", pa.string()), ("path", pa.string()), ("mode", pa.int64()), ("size", pa.int64()), ("mtime_unix", pa.int64()), ("file_digest", pa.string()), ("chunk_digests", pa.list_(pa.string()))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return files.select("content").mapInArrow(run, MANIFEST_ROWS)


def save_manifests(manifests: DataFrame, folder: str, created_unix: int = 0) -> None:
    """Write each snapshot's manifest as a file ID.manifest of a folder that all executors mount."""
    import os

    def run(rows) -> None:
        for r in rows:
            with open(f"{folder}/{r['snapshot_id']}.manifest.tmp", "wb") as f:
                f.write(r["content"])
            os.replace(f.name, f.name.removesuffix(".tmp"))

    os.makedirs(folder, exist_ok=True)
    write_manifests(manifests, created_unix).foreachPartition(run)


def load_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all files *.manifest of a folder; other files are passed over."""
    return read_manifests(spark.read.format("binaryFile").option("pathGlobFilter", "*.manifest").load(folder))


def wal_frames(records: DataFrame, record_type: int = WAL_TYPE) -> DataFrame:
    """k and frame (53 bytes) of records of k, digest (hex), offset and length."""
    body = F.concat(F.lit(bytes([record_type])), F.unhex("digest"), le_bytes(F.col("offset"), 8), le_bytes(F.col("length"), 4))
    return records.select("k", F.concat(le_bytes(F.lit(WAL_BODY), 4), body, le_bytes(F.crc32(body), 4)).alias("frame"))


def wal_records(logs: DataFrame, key: str = "log", content: str = "content", types: tuple[int, ...] = (WAL_TYPE,)) -> DataFrame:
    """Frames of each log up to the first bad or incomplete one: log, k, digest, offset, length.

    A frame of another type than ``types`` is a bad one; all types share the frame's size.
    """
    kept = logs.schema[key]

    def run(batches):
        for batch in batches:
            for row, cell in enumerate(batch.column(1)):
                if cell.is_valid:
                    for first, frames in _wal_valid(memoryview(cell.as_buffer()), types):
                        yield _wal_batch(batch.column(0), row, first, frames)

    rows = T.StructType([T.StructField(key, kept.dataType), *T.StructType.fromDDL("k int, digest string, offset decimal(20,0), length long")])
    return logs.select(key, content).mapInArrow(run, rows)


def _wal_valid(raw: memoryview, types: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Frames before the first bad one: the first one's number and up to WAL_SLICE frames at a time."""
    for first in range(0, len(raw) // WAL_FRAME, WAL_SLICE):
        n = min(WAL_SLICE, len(raw) // WAL_FRAME - first)
        frames = np.frombuffer(raw, _WAL, n, first * WAL_FRAME)
        begin = first * WAL_FRAME + 4
        crcs = np.fromiter((zlib.crc32(raw[at : at + WAL_BODY]) for at in range(begin, begin + n * WAL_FRAME, WAL_FRAME)), np.uint32, n)
        bad = np.flatnonzero((frames["size"] != WAL_BODY) | ~np.isin(frames["type"], types) | (frames["crc"] != crcs))
        if len(bad):
            frames = frames[: bad[0]]
        if len(frames):
            yield first, frames
        if len(bad):
            return


def _wal_batch(keys: pa.Array, row: int, first: int, frames: np.ndarray) -> pa.RecordBatch:
    n = len(frames)
    text = _HEX[frames["digest"]].tobytes()
    digests = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.py_buffer(text))
    wide = np.zeros((n, 2), "<u8")  # of 128 bits, as a decimal is
    wide[:, 0] = frames["offset"]
    offsets = pa.Array.from_buffers(pa.decimal128(20, 0), n, [None, pa.py_buffer(wide)])
    columns = [keys.take(pa.array(np.full(n, row))), pa.array(np.arange(first, first + n, dtype=np.int32)), digests, offsets, pa.array(frames["length"].astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["key", "k", "digest", "offset", "length"])


def wal_index(records: DataFrame, key: str = "log") -> DataFrame:
    """Index that replaying leaves: of each digest the last record."""
    return records.groupBy(key, "digest").agg(F.max_by("offset", "k").alias("offset"), F.max_by("length", "k").alias("length"))
