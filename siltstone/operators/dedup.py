"""Dedup joins and aggregates over chunks (path, seq, offset, length, content_defined, digest)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.columns import dedup_factor, percent_saved
from siltstone.operators.ordering import running_total


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """digest, length and number of references: combined before the shuffle, so a hot digest is one row a task."""
    return chunks.groupBy("digest").agg(F.min("length").alias("length"), F.count(F.lit(1)).alias("refs"))


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """digest and length of the chunks that the index lacks, once each."""
    return unique_chunks(chunks).select("digest", "length").join(index.select("digest"), "digest", "left_anti")


def known_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    return unique_chunks(chunks).select("digest", "length").join(index.select("digest"), "digest", "left_semi")


def dedup_summary(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """References, their bytes, hits and misses of a batch against an index; a repeat in the batch is a hit."""
    known = index.select("digest").distinct().withColumn("known", F.lit(True))
    rows = unique_chunks(chunks).join(known, "digest", "left")
    miss = F.when(F.col("known").isNull(), 1).otherwise(0)
    return rows.agg(
        F.coalesce(F.sum("refs"), F.lit(0)).alias("logical_chunks"),
        F.coalesce(F.sum(F.col("refs") * F.col("length")), F.lit(0)).alias("logical_bytes"),
        F.coalesce(F.sum(miss), F.lit(0)).alias("misses"),
        F.coalesce(F.sum("refs") - F.sum(miss), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(miss * F.col("length")), F.lit(0)).alias("new_bytes"),
    )


def size_stats(chunks: DataFrame) -> DataFrame:
    """Count, bytes, mean, upper median, least and largest of chunk lengths; zeros for no chunks."""
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length DESC)")
    zero = lambda c, name, kind="long": F.coalesce(c.cast(kind), F.lit(0).cast(kind)).alias(name)
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), zero(F.sum("length"), "bytes"), zero(F.avg("length"), "mean", "double"), zero(median, "median"), zero(F.min("length"), "least"), zero(F.max("length"), "largest"))


def size_histogram(chunks: DataFrame, width: int = 4096, last: int = 16) -> DataFrame:
    """Chunks in buckets of ``width`` bytes, the last open; empty buckets are left out."""
    bucket = F.least((F.col("length") / F.lit(width)).cast("int"), F.lit(last)).alias("bucket")
    return chunks.groupBy(bucket).agg(F.count(F.lit(1)).alias("chunks"))


def boundary_origin(spans: DataFrame) -> DataFrame:
    total, defined = F.count(F.lit(1)), F.count_if("content_defined")
    return spans.agg(total.alias("total"), defined.alias("content_defined"), (total - defined).alias("positional"), F.when(total == 0, 0.0).otherwise(100.0 * (total - defined) / total).alias("positional_percent"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct digests of either side, shared, and of one side only: one aggregation, no join."""
    both = old.select("digest").distinct().withColumn("o", F.lit(1)).withColumn("n", F.lit(0)).unionAll(new.select("digest").distinct().withColumn("o", F.lit(0)).withColumn("n", F.lit(1)))
    sides = both.groupBy("digest").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return sides.agg(total(F.col("o"), "old_chunks"), total(F.col("n"), "new_chunks"), total(F.col("o") * F.col("n"), "shared"), total(F.col("o") * (1 - F.col("n")), "only_old"), total(F.col("n") * (1 - F.col("o")), "only_new"))


def shared(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("digest").intersect(new.select("digest"))


def only_first(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("digest").subtract(second.select("digest"))


def first_references(refs: DataFrame) -> DataFrame:
    """The first reference of each digest by (snapshot_id, path, seq): a minimum of structs, combined before the shuffle."""
    return refs.groupBy("digest").agg(F.min(F.struct("snapshot_id", "path", "seq")).alias("f")).select("digest", "f.snapshot_id", "f.path", "f.seq")


def pack_layout(chunks: DataFrame) -> DataFrame:
    """Offset of every distinct chunk in one pack, in order of first reference (path, seq)."""
    firsts = chunks.groupBy("digest").agg(F.min("length").alias("length"), F.min(F.struct("path", "seq")).alias("f")).select("digest", "length", "f.path", "f.seq")
    return running_total(firsts, ["path", "seq"], F.col("length").cast("long"), "offset").select("digest", "length", "offset")


def summary_by_strategy(old: DataFrame, new: DataFrame) -> DataFrame:
    """What ``dedup_summary`` says of a new batch against an old one, for each strategy of (strategy, digest, length): one aggregation by chunk."""
    both = old.select("strategy", "digest", "length", F.lit(0).alias("n")).unionByName(new.select("strategy", "digest", "length", F.lit(1).alias("n")))
    rows = both.groupBy("strategy", "digest").agg(F.sum("n").alias("refs"), F.min("length").alias("length"), F.min("n").alias("miss")).filter("refs > 0")
    total = lambda c, name: F.sum(c).alias(name)
    return rows.groupBy("strategy").agg(total("refs", "logical_chunks"), total(F.col("refs") * F.col("length"), "logical_bytes"), total(F.col("miss").cast("long"), "misses"), total(F.col("refs") - F.col("miss"), "hits"), total((F.col("miss") * F.col("length")).cast("long"), "new_bytes"))


def locate(wanted: DataFrame, packed: DataFrame) -> DataFrame:
    """Place of every wanted digest; offset and length 0 where it is unknown."""
    found = wanted.select("digest").distinct().join(packed, "digest", "left")
    return found.select("digest", F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("length", F.lit(0)).alias("length"))


def stats_report(manifests: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots, logical and physical bytes, savings, and chunk sizes as one row."""
    logical = manifests.agg(F.count_distinct("snapshot_id").alias("snapshots"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))
    row = logical.crossJoin(size_stats(stored))  # one row each
    saved, factor = percent_saved(F.col("logical_bytes"), F.col("bytes")), dedup_factor(F.col("logical_bytes"), F.col("bytes"))
    return row.select("snapshots", "logical_bytes", F.col("bytes").alias("physical_bytes"), saved.alias("saved_percent"), factor.alias("factor"), F.col("chunks").alias("unique_chunks"), "mean", "median", F.format_string("%.1f%% (%.2fx)", saved, factor).alias("summary"))
