"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontam, neardup, quality, sp_bpe
from siltstone.llm.common import drop, materialize, table, with_rows, without_ids


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Rows without an id stay; of rows that repeat an id the one with the smallest text stays.
    """
    found = materialize(neardup.near_duplicates(docs, width=5, percent=80).select("doc_id", "kept"), "kept")
    known = found.filter("doc_id is not null")
    gone = materialize(known.filter("not kept").select("doc_id").distinct(), "gone")
    kept = without_ids(docs, gone)
    twice = materialize(known.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    drop(found)
    if twice.isEmpty():
        return kept
    names = docs.columns
    same = with_rows(kept, twice, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*names), F.coalesce("text", F.lit(""))).alias("x")).select("x.*")
    return without_ids(kept, twice).select(names).unionByName(same.select(names))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, with an end id each."""
    return sp_bpe.encode_documents(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("encode", encode_stage)]

#: SQL can't express the classifier nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
