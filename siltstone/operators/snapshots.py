"""Manifests, restore and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.columns import concat_ordered, sha256
from siltstone.operators.chunking import ChunkConfig, recipes


def build_manifest(files: DataFrame, config: ChunkConfig, keep: tuple[str, ...] = ("mode", "mtime_unix")) -> DataFrame:
    """path, mode, size, mtime_unix, file_digest and chunk digests in order; empty files have an empty list.

    One pass over the files without a shuffle; rows that repeat a path stay apart.
    """
    return manifest_of(recipes(files, config, keep=keep))


def manifest_of(rows: DataFrame) -> DataFrame:
    """The manifest of ``chunking.recipes``."""
    return rows.withColumn("chunk_digests", F.transform("chunks", lambda c: c["digest"])).drop("chunks")


def repeated_paths(rows: DataFrame) -> DataFrame:
    """Paths that several rows have: a manifest can't hold them."""
    return rows.groupBy("path").count().filter("count > 1").select("path")


def same_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether two manifests hold the same entries, chunk lists and all, and how many entries only one of them has."""
    names = left.columns
    side = lambda df, n: df.select(*names).withColumn("_side", F.lit(n))
    both = side(left, 1).unionByName(side(right, -1))
    odd = both.groupBy(*names).agg(F.sum("_side").alias("n"))
    only = lambda c, name: F.coalesce(F.sum(F.when(c, F.abs("n")).otherwise(0)), F.lit(0)).cast("long").alias(name)
    return odd.agg(only(F.col("n") > 0, "only_left"), only(F.col("n") < 0, "only_right")).select(((F.col("only_left") + F.col("only_right")) == 0).alias("equal"), "only_left", "only_right")


def references(manifests: DataFrame) -> DataFrame:
    """snapshot_id, path, seq, digest of every reference."""
    return manifests.select("snapshot_id", "path", F.posexplode("chunk_digests").alias("seq", "digest"))


def good_chunks(stored: DataFrame) -> DataFrame:
    """digest and data of every stored chunk whose bytes have that digest, once each; of several copies any will do."""
    return stored.filter(sha256(F.col("data")) == F.col("digest")).select("digest", "data").dropDuplicates(["digest"])


def restore(manifests: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest rows with ``content`` put together from stored chunks (digest, data; once each), null if one is missing; empty files survive."""
    refs = manifests.select("snapshot_id", "path", F.posexplode("chunk_digests").alias("seq", "digest")).join(stored.select("digest", "data"), "digest", "left")
    built = refs.groupBy("snapshot_id", "path").agg(F.count_if(F.col("data").isNull()).alias("_missing"), concat_ordered(F.collect_list(F.struct("seq", "data"))).alias("_built"))
    rows = manifests.join(built, ["snapshot_id", "path"], "left")
    empty = F.size("chunk_digests") == 0
    return rows.withColumn("content", F.when(empty, F.lit(b"")).when(F.col("_missing") == 0, F.col("_built"))).drop("_missing", "_built")


def check_restored(restored: DataFrame) -> DataFrame:
    """snapshot_id, path, restored size, digest, and whether it is the manifest's."""
    digest = sha256(F.col("content"))
    return restored.select("snapshot_id", "path", F.octet_length("content").cast("long").alias("size"), digest.alias("digest"), F.coalesce(digest == F.col("file_digest"), F.lit(False)).alias("ok"))


def chunk_status(manifests: DataFrame, stored: DataFrame) -> DataFrame:
    """digest and status (ok, corrupt, missing) of every referenced chunk; ok if any stored copy is.

    Bytes are hashed where they are read; only digests are shuffled.
    """
    refs = references(manifests).select("digest").distinct()
    found = stored.select("digest", (sha256(F.col("data")) == F.col("digest")).alias("_ok")).groupBy("digest").agg(F.bool_or(F.coalesce("_ok", F.lit(False))).alias("_ok"))
    rows = refs.join(found, "digest", "left")
    return rows.select("digest", F.when(F.col("_ok").isNull(), "missing").when(F.col("_ok"), "ok").otherwise("corrupt").alias("status"))


def issues(manifests: DataFrame, status: DataFrame) -> DataFrame:
    """One row for each reference to a missing or corrupt chunk."""
    bad = status.filter("status <> 'ok'")
    return references(manifests).join(bad, "digest").select("snapshot_id", "path", "seq", "digest", "status")


def verify_summary(manifests: DataFrame, status: DataFrame) -> DataFrame:
    """Snapshots, files, references, distinct good chunks and issues: one row."""
    files = manifests.agg(F.count_distinct("snapshot_id").alias("snapshots_checked"), F.count(F.lit(1)).alias("files_checked"))
    refs = references(manifests).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(status, "digest")
    bad = F.when(F.col("status") != "ok", F.col("n")).otherwise(0)
    counts = refs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("references_checked"), F.count_if(F.col("status") == "ok").alias("unique_chunks_verified"), F.coalesce(F.sum(bad), F.lit(0)).alias("issues"))
    return files.crossJoin(counts)  # one row each


def compare_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """path and state (missing, extra, differs) of files that aren't the same on both sides."""
    a = left.select("path", sha256(F.col("content")).alias("a"))
    b = right.select("path", sha256(F.col("content")).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "differs")
    return a.join(b, "path", "full").select("path", state.alias("state")).filter("state is not null")
