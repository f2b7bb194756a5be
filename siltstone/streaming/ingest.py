"""Structured Streaming into a repository: every micro-batch of files becomes a snapshot of new chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.repository import Repository


def ingest(files: DataFrame, repo: Repository, checkpoint: str) -> StreamingQuery:
    """Start backing up a stream of (path, mode, mtime_unix, content).

    A snapshot is labelled by the stream's checkpoint and the batch's number, so a batch that is replayed after
    its commit makes no second one; replayed before it, its chunks are in the index by then.
    """
    return files.writeStream.foreachBatch(lambda batch, number: store(batch, number, repo, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store(batch: DataFrame, number: int, repo: Repository, stream: str) -> None:
    """Back up one micro-batch, once."""
    label = f"{stream}#{number}"
    if not repo.has_label(label) and not batch.isEmpty():
        repo.backup(batch, label=label)
