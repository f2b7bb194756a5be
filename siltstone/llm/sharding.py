"""Sharding by a permutation-filled lookup table (native: DataFrame functions only).

Each shard has its own order of preference over the slots of a prime-sized table. The shards take
turns, and in its turn each claims the first slot on its list that is still free. A row's key is
hashed to a slot, and the table, broadcast to all executors, names its shard in constant time.
Adding or removing one shard moves little more than that shard's part of the slots.

The table has exactly ``table_size`` rows, a parameter with an upper bound, so its broadcast does not
grow with the data. Placement needs no shuffle.

Defined cases: a null key column counts as the empty string; repeated rows get the same shard;
empty tables give empty results; columns named like an output are replaced by that output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 2053  # prime; over 100 slots for each of the default shards
MAX_TABLE_SIZE = 1_000_003
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
_HEX = 15  # hex digits of md5 that are used: they fit a signed 64-bit integer


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16)


def lookup_table(shards: Sequence[str] = SHARDS, table_size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not len(shards) <= table_size <= MAX_TABLE_SIZE or any(table_size % k == 0 for k in range(2, int(table_size**0.5) + 1)):
        raise ValueError(f"table_size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    place = [_hash(f"{s}/offset") % table_size for s in shards]
    step = [_hash(f"{s}/skip") % (table_size - 1) + 1 for s in shards]
    owner = [-1] * table_size
    for turn in range(table_size):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + step[i]) % table_size
        owner[place[i]] = i
    return owner


def slot_of(keys: Sequence[Column], table_size: int = TABLE_SIZE) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10).cast("long") % table_size


def assign_shards(df: DataFrame, keys: Sequence[str] = ("doc_id",), shards: Sequence[str] = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string)."""
    owner = ",".join(map(str, lookup_table(shards, table_size)))
    names = F.array(*[F.lit(s) for s in shards])
    slots = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("_silt_slot", "_silt_owner"))
    slots = slots.select(F.col("_silt_slot").cast("long").alias("_silt_slot"), F.element_at(names, F.col("_silt_owner").cast("int") + 1).alias("shard"))
    placed = df.drop("shard").withColumn("slot", slot_of([df[k] for k in keys], table_size))
    return placed.join(F.broadcast(slots), placed["slot"] == slots["_silt_slot"], "left").drop("_silt_slot")


def write_shards(df: DataFrame, path: str, files_per_shard: int = 8, **options) -> None:
    """Write one folder for each shard; rows of a shard are salted over ``files_per_shard`` tasks, so a hot shard isn't one task."""
    placed = assign_shards(df, **options)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_shard)).alias("_silt_salt")
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
