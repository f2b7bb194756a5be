"""Chunkers: table functions from a file's bytes to spans (seq, offset, length, content_defined).

A chunk that the content ends is followed by the next without gap, so a file's cuts depend on each
other; this one step runs in a numpy kernel, which also takes the digests, as it has the bytes at
hand. All other steps are DataFrame operators. ``recipes`` is the one pass over the bytes: a row for
each file with its size, digest and chunks; whatever else is asked of chunks is asked of its rows.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import cut, sha256
from siltstone.functions.gear import gear_table, low_ones, mask_bits

SPANS = "seq int, offset long, length int, content_defined boolean"
CHUNK = "struct<seq:int,offset:long,length:int,content_defined:boolean,digest:string>"
MAX_FILE = 2**31 - 64
WINDOW = 1 << 18  # bytes that are hashed at a time
Span = tuple[int, int, bool]


@dataclass(frozen=True)
class Hasher:
    """A digest, lower-case hex, of a binary column and of bytes."""

    name: str
    column: Callable[[Column], Column]
    plain: Callable[[bytes], str]


SHA256 = Hasher("sha256", sha256, lambda raw: hashlib.sha256(raw).hexdigest())


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes of content-defined chunks in bytes; ``strategy`` is "cdc", "fixed" (then avg_size counts) or a registered one."""

    min_size: int = 2048
    avg_size: int = 8192
    max_size: int = 65536
    strategy: str = "cdc"

    def __post_init__(self):
        if self.strategy not in CHUNKERS:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.strategy == "fixed" and self.avg_size <= 0:
            raise ValueError("a fixed chunk size must be positive")
        if self.strategy == "cdc" and not 0 <= self.min_size < self.avg_size < self.max_size:
            raise ValueError("chunk sizes must satisfy min < avg < max")

    @classmethod
    def of_kib(cls, kib: int, fixed: bool = False) -> ChunkConfig:
        """Sizes derived from an average in KiB."""
        return cls(kib * 1024 // 4, kib * 1024, kib * 1024 * 8, "fixed" if fixed else "cdc")


def _hits(data: bytes, strict_bits: int, loose_bits: int) -> tuple[array, array]:
    """Places whose hash passes the strict and the loose mask, found window by window.

    The low N bits of a gear hash depend on its last N bytes only, and more bytes change nothing in them,
    so sums over 1, 2, 4, ... bytes are doubled until they reach N.
    """
    kind = np.uint32 if strict_bits <= 32 else np.uint64
    gear, strict, loose = gear_table().astype(kind), kind(low_ones(strict_bits)), kind(low_ones(loose_bits))
    view, back = np.frombuffer(data, np.uint8), 1
    while back < strict_bits:
        back *= 2
    found = array("q"), array("q")
    for begin in range(0, len(view), WINDOW):
        first = max(0, begin - back)
        total = gear[view[first : begin + WINDOW]]
        width = 1
        while width < back:
            total[width:] += total[:-width] << kind(width)
            width *= 2
        total = total[begin - first :]
        at = np.flatnonzero(total & loose == 0)
        found[1].frombytes((at + begin).astype(np.int64).tobytes())
        found[0].frombytes((at[total[at] & strict == 0] + begin).astype(np.int64).tobytes())
    return found


def cdc_cuts(data: bytes, config: ChunkConfig) -> list[Span]:
    """(offset, length, whether the content ended it) of every chunk of a file's bytes.

    Hashing begins min_size bytes into a chunk: the first N - 1 tests see fewer bytes, and these few hashes
    are taken one by one behind each cut.
    """
    n = len(data)
    if not n:
        return []
    strict_bits, loose_bits = mask_bits(config.avg_size)
    strict, loose = low_ones(strict_bits), low_ones(loose_bits)
    gear = [int(g) & strict for g in gear_table()]
    at_strict, at_loose = _hits(data, strict_bits, loose_bits) if config.min_size < n else (array("q"), array("q"))

    def first(places: array, low: int, high: int) -> int:
        k = bisect_left(places, low)
        return places[k] if k < len(places) and places[k] < high else -1

    spans, start = [], 0
    while start < n:
        left = n - start
        if left <= config.min_size:
            spans.append((start, left, False))
            break
        window = min(left, config.max_size)
        warm = min(start + config.min_size + strict_bits - 1, start + window)
        hit, total, middle = -1, 0, start + config.avg_size
        for p in range(start + config.min_size, warm):
            total = (total << 1) + gear[data[p]] & strict
            if not total & (strict if p < middle else loose):
                hit = p
                break
        if hit < 0:
            hit = first(at_strict, warm, min(middle, start + window))
        if hit < 0:
            hit = first(at_loose, max(warm, middle), start + window)
        length = hit - start + 1 if hit >= 0 else window
        spans.append((start, length, hit >= 0))
        start += length
    return spans


def fixed_cuts(data: bytes, config: ChunkConfig) -> list[Span]:
    return [(at, min(config.avg_size, len(data) - at), False) for at in range(0, len(data), config.avg_size)]


#: Chunkers by strategy: functions from a file's bytes and a config to spans that cover them without gap.
CHUNKERS: dict[str, Callable[[bytes, ChunkConfig], list[Span]]] = {"cdc": cdc_cuts, "fixed": fixed_cuts}


def register_chunker(strategy: str, chunker: Callable[[bytes, ChunkConfig], list[Span]]) -> None:
    """Make a chunker of one's own a strategy of ``ChunkConfig``."""
    CHUNKERS[strategy] = chunker


def _checked(data: bytes | None) -> bytes:
    data = data or b""
    if len(data) > MAX_FILE:
        raise ValueError("files over 2 GiB don't fit a binary column")
    return data


def recipes(files: DataFrame, config: ChunkConfig, key: str = "path", content: str = "content", keep: tuple[str, ...] = (), hasher: Hasher = SHA256) -> DataFrame:
    """key, the columns to keep, size, file_digest and chunks of every file, in one pass and without a shuffle.

    Null contents count as empty; empty files have no chunks.
    """
    if config.strategy == "fixed":
        n, size, raw = F.octet_length(content), config.avg_size, F.col(content)

        def chunk(i: Column) -> Column:
            offset, length = i.cast("long") * size, F.least(F.lit(size), n - i * size).cast("int")
            return F.struct(i.alias("seq"), offset.alias("offset"), length.alias("length"), F.lit(False).alias("content_defined"), hasher.column(cut(raw, offset, length)).alias("digest"))

        found = F.when(n > 0, F.transform(F.sequence(F.lit(0), ((n - 1) / F.lit(size)).cast("int")), chunk)).otherwise(F.array().cast(f"array<{CHUNK}>"))
        whole = F.coalesce(raw, F.lit(b""))
        return files.select(key, *keep, F.octet_length(whole).cast("long").alias("size"), hasher.column(whole).alias("file_digest"), found.alias("chunks"))
    chunker, plain = CHUNKERS[config.strategy], hasher.plain
    item = pa.struct([("seq", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("content_defined", pa.bool_()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, found = [], [], []
            for data in batch.column(0):
                data = _checked(data.as_py())
                view = memoryview(data)
                sizes.append(len(data))
                digests.append(plain(data))
                found.append([{"seq": k, "offset": o, "length": n, "content_defined": c, "digest": plain(view[o : o + n])} for k, (o, n, c) in enumerate(chunker(data, config))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(found, pa.list_(item))], [key, *keep, "size", "file_digest", "chunks"])

    kinds = dict(files.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in (key, *keep))
    return files.select(content, key, *keep).mapInArrow(run, f"{schema}size long, file_digest string, chunks array<{CHUNK}>")


def chunks_of(rows: DataFrame, key: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, columns to keep, seq, offset, length, content_defined and digest of every chunk of ``recipes``."""
    return rows.select(key, *keep, F.explode("chunks").alias("c")).select(key, *keep, "c.seq", "c.offset", "c.length", "c.content_defined", "c.digest")


def chunks(files: DataFrame, config: ChunkConfig, key: str = "path", content: str = "content") -> DataFrame:
    """Spans with the digest of their bytes; the bytes themselves stay with their file."""
    return chunks_of(recipes(files, config, key, content), key)


def chunks_by_strategy(files: DataFrame, configs: dict[str, ChunkConfig], key: str = "path", content: str = "content", hasher: Hasher = SHA256) -> DataFrame:
    """key, strategy, seq, length and digest of every chunk by each of several configurations, in one pass over the bytes."""
    kernels, plain = [(name, CHUNKERS[c.strategy], c) for name, c in configs.items()], hasher.plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rows = [], []
            for data in batch.column(0):
                data, before = _checked(data.as_py()), len(rows)
                view = memoryview(data)
                for name, chunker, config in kernels:
                    rows += [(name, k, n, plain(view[o : o + n])) for k, (o, n, _) in enumerate(chunker(data, config))]
                counts.append(len(rows) - before)
            take = pa.array(np.repeat(np.arange(len(batch)), counts))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), *columns], [key, "strategy", "seq", "length", "digest"])

    return files.select(content, key).mapInArrow(run, f"`{key}` {dict(files.dtypes)[key]}, strategy string, seq int, length int, digest string")


def spans(files: DataFrame, config: ChunkConfig, key: str = "path", content: str = "content") -> DataFrame:
    """Spans of every file, without digests; empty and null contents have none."""
    if config.strategy == "fixed":
        return fixed_spans(files, config.avg_size, key, content)
    chunker = CHUNKERS[config.strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, rows = batch.column(0), [], []
            for data in batch.column(1):
                found = chunker(_checked(data.as_py()), config)
                counts.append(len(found))
                rows += [(k, *s) for k, s in enumerate(found)]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            take = pa.array(np.repeat(np.arange(len(batch)), counts))
            yield pa.RecordBatch.from_arrays([keys.take(take), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], [key, "seq", "offset", "length", "content_defined"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {dict(files.dtypes)[key]}, {SPANS}")


def cdc_spans(files: DataFrame, config: ChunkConfig = ChunkConfig(), key: str = "path", content: str = "content") -> DataFrame:
    """Spans of content-defined chunks of every file."""
    if config.strategy != "cdc":
        raise ValueError("the configuration isn't one of content-defined chunks")
    return spans(files, config, key, content)


def fixed_spans(files: DataFrame, size: int, key: str = "path", content: str = "content") -> DataFrame:
    """Spans of equal chunks, the last one shorter: built-in functions only."""
    if size <= 0:
        raise ValueError("a fixed chunk size must be positive")
    n = F.octet_length(content)
    rows = files.filter(n > 0).select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / F.lit(size)).cast("int"))).alias("seq"))
    offset = F.col("seq").cast("long") * size
    return rows.select(key, "seq", offset.alias("offset"), F.least(F.lit(size), F.col("n") - offset).cast("int").alias("length"), F.lit(False).alias("content_defined"))


def register_udtf(spark: SparkSession, name: str = "cdc_chunks", config: ChunkConfig = ChunkConfig()) -> None:
    """SQL: SELECT ... FROM files, LATERAL cdc_chunks(content)."""
    from pyspark.sql.functions import udtf

    class CdcChunks:
        def eval(self, content: bytes):
            for k, span in enumerate(cdc_cuts(bytes(content or b""), config)):
                yield (k, *span)

    spark.udtf.register(name, udtf(CdcChunks, returnType=SPANS))
