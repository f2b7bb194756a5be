"""What the training-data operators share: tables, the shared folder, learned-split columns."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.storage import drop as drop
from siltstone.storage import materialize as materialize

#: Rows of ids that may be broadcast: some tens of megabytes. Beyond that a Bloom filter goes first.
BROADCAST_ROWS = 1_000_000
BLOOM_SLICE, BLOOM_SLICES = 1 << 19, 1 << 10  # bits of a slice, and slices at most: 64 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bloom(ids: DataFrame, n: int) -> np.ndarray:
    """Slices of bits of a Bloom filter of one column of n longs, of a bounded size: each id sets four bits of one slice."""
    slices = 1
    while slices < BLOOM_SLICES and slices * BLOOM_SLICE < 16 * n:
        slices *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for batch in batches:
            part, ids_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in np.unique(part):
                if s != now:
                    if bits is not None:
                        yield pa.RecordBatch.from_pydict({"slice": [now], "bits": [np.packbits(bits).tobytes()]})
                    now, bits = s, np.zeros(BLOOM_SLICE, bool)
                for at in _places(ids_[part == s]):
                    bits[at] = True
        if bits is not None:
            yield pa.RecordBatch.from_pydict({"slice": [now], "bits": [np.packbits(bits).tobytes()]})

    name = ids.columns[0]
    dealt = ids.select(F.pmod(F.xxhash64(name), F.lit(slices)).alias("slice"), name).repartition("slice").sortWithinPartitions("slice")
    out = np.zeros((slices, BLOOM_SLICE // 8), np.uint8)
    for row in dealt.mapInArrow(run, "slice long, bits binary").collect():  # one row a slice, 64 kB each
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out


def _places(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Four places of each id in its slice."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    for k in (0, 13, 26, 39):
        yield (x >> np.uint64(k) & np.uint64(BLOOM_SLICE - 1)).astype(np.int64)


def possibly_among(key: str, ids: DataFrame, n: int) -> Column:
    """A column that is true for every key among the n ids, and for few others."""
    bits = ids.sparkSession.sparkContext.broadcast(_bloom(ids, n))

    def test(part, keys):
        held, found = bits.value, np.ones(len(keys), bool)
        slices = part.to_numpy(np.int64)
        for at in _places(keys.to_numpy(np.int64)):
            found &= held[slices, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
        import pandas as pd

        return pd.Series(found)

    udf = F.pandas_udf(test, "boolean")
    whole = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    slices = len(bits.value)
    return F.col(key).isNotNull() & udf(F.pmod(F.xxhash64(whole), F.lit(slices)), whole)


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key isn't among the ids (one column of distinct longs, a written table).

    Few ids are broadcast. With more, a Bloom filter of a bounded size lets the rows that are surely not
    among them pass where they are, and only the others are shuffled and joined; the result is exact.
    """
    n, gone = ids.count(), ids.toDF("_silt_id")
    if n <= most:
        return df.join(F.broadcast(gone), F.col(key) == F.col("_silt_id"), "left_anti")
    marked = df.withColumn("_silt_maybe", possibly_among(key, ids, n))
    rest = marked.filter("_silt_maybe").join(gone, F.col(key) == F.col("_silt_id"), "left_anti")
    return marked.filter("not _silt_maybe").unionAll(rest).drop("_silt_maybe")


def with_rows(df: DataFrame, rows: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``df`` with a written table of longs by a key both have: broadcast where it is small,
    else only rows of ``df`` that pass a Bloom filter are shuffled."""
    n = rows.count()
    if n <= most:
        return df.join(F.broadcast(rows), key)
    return df.filter(possibly_among(key, rows.select(key).distinct(), n)).join(rows, key)


def documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only ``doc_id`` and the whole text, null text as empty: no other column can clash later on."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def id_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``SILTSTONE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("SILTSTONE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """A bounded cache of a function of one key: ``memo[key]`` computes what is missing, and a full cache starts anew."""

    def __init__(self, of, cap: int):
        super().__init__()
        self.of, self.cap = of, cap

    def __missing__(self, key):
        got = self.of(key)
        if len(self) >= self.cap:
            self.clear()
        self[key] = got
        return got

    def __reduce__(self):
        return Memo, (self.of, self.cap)
