"""How far an edit moves chunk boundaries: new chunks by edit, and by the place of one more byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.chunking import CHUNKERS, SHA256, ChunkConfig, Hasher

PAYLOAD = b"\xab"


def distribution(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many files (path, edit, chunks) have how many distinct chunks that their former version (path, chunks) lacks.

    A file's digests meet those of its former version in one row; a file without a former version has new chunks only.
    """
    digests = lambda c: F.array_distinct(F.transform(c, lambda x: x["digest"]))
    rows = new.filter(F.size("chunks") > 0).join(old.select("path", digests("chunks").alias("_old")), "path", "left")
    fresh = F.size(F.array_except(digests("chunks"), F.coalesce("_old", F.array().cast("array<string>")))).cast("long")
    return rows.groupBy(fresh.alias("new_chunks")).agg(F.count(F.lit(1)).alias("files"), F.min("edit").alias("least_edit"), F.max("edit").alias("largest_edit"))


def place(path: str, trial: int, size: int) -> int:
    """Where a trial inserts its byte: the number that 48 bits of an md5 are, modulo the places there are."""
    return int(hashlib.md5(f"{path}#{trial}".encode()).hexdigest()[:12], 16) % (size + 1)


def trials_of(path: str, data: bytes, config: ChunkConfig, trials: int, hasher: Hasher = SHA256) -> list[int]:
    """New distinct chunks after PAYLOAD is inserted, for each trial's place."""
    chunker = CHUNKERS[config.strategy]
    digests = lambda raw: {hasher.plain(raw[o : o + n]) for o, n, _ in chunker(raw, config)}
    old, out = digests(data), []
    for trial in range(trials):
        at = place(path, trial, len(data))
        out.append(len(digests(data[:at] + PAYLOAD + data[at:]) - old))
    return out


def sweep(files: DataFrame, configs: dict[str, ChunkConfig], trials: int) -> DataFrame:
    """path, strategy, least, largest and mean number of new chunks over the trials, for every file that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                for name, config in configs.items() if data else ():
                    counts = trials_of(path, data, config, trials)
                    rows.append((path, name, min(counts), max(counts), sum(counts) / trials, trials))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "strategy", "least", "largest", "mean", "trials"])

    return files.select("path", "content").mapInArrow(run, "path string, strategy string, least long, largest long, mean double, trials long")
