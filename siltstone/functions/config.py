"""Comparison of chunking configurations, field by field."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from siltstone.operators.chunking import ChunkConfig

FIELDS = ("strategy", "min_size", "avg_size", "max_size")


def mismatches(own: ChunkConfig) -> Column:
    """Names of the FIELDS, columns here, in which a configuration isn't ``own``."""
    wrong = [F.when(~F.col(name).eqNullSafe(F.lit(getattr(own, name))), F.lit(name)) for name in FIELDS]
    return F.filter(F.array(*wrong), lambda x: x.isNotNull())
