"""Column functions: digests, byte edits, little-endian codecs, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(content, 256)


def cut(content: Column, offset: Column, length: Column) -> Column:
    """Bytes of a span."""
    return F.substring(content, (offset + 1).cast("int"), length.cast("int"))


def insert_bytes(content: Column, offset: Column, payload: bytes) -> Column:
    n = F.octet_length(content)
    return F.concat(cut(content, F.lit(0), offset), F.lit(payload), cut(content, offset, n - offset))


def delete_bytes(content: Column, offset: Column, count: int) -> Column:
    n = F.octet_length(content)
    return F.concat(cut(content, F.lit(0), offset), cut(content, offset + count, F.greatest(n - offset - count, F.lit(0))))


def percent_saved(logical: Column, physical: Column) -> Column:
    """0 where nothing is stored."""
    return F.when(logical == 0, F.lit(0.0)).otherwise(100.0 * (1.0 - physical / logical))


def dedup_factor(logical: Column, physical: Column) -> Column:
    return F.when(physical == 0, F.lit(0.0)).otherwise(logical / physical)


def mode_bits(mode: Column) -> Column:
    """Permission bits of a file mode."""
    return mode.bitwiseAND(0o7777)


def snapshot_id(ts: Column) -> Column:
    """YYYYMMDD-HHMMSS in the session's time zone, which is UTC in this engine."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def le_bytes(value: Column, size: int) -> Column:
    """Little-endian bytes of a non-negative integer."""
    text = F.lpad(F.hex(value.cast("long")), size * 2, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))]))


def concat_ordered(rows: Column) -> Column:
    """Bytes of an array of (seq, data) in order of seq, in one pass: as strings, whose bytes nothing changes."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["data"].cast("string")), "").cast("binary")
