"""Running totals over a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import materialize


def running_total(df: DataFrame, order: list[str], value: Column, name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before each one, in ``order`` within its group.

    Rows are cut into ranges of the order and written, so that both steps see the same ranges. A window adds up
    inside each range, and the ranges' sums, a row for each range and group, are broadcast.
    """
    ranges = df.withColumn("_silt_v", value).repartitionByRange(*group, *order).withColumn("_silt_r", F.spark_partition_id())
    rows = materialize(ranges, "ranges")
    sums = rows.groupBy(*group, "_silt_r").agg(F.sum("_silt_v").alias("_silt_s"))
    before = sums.withColumn("_silt_b", F.sum("_silt_s").over(Window.partitionBy(*group).orderBy("_silt_r")) - F.col("_silt_s")).select(*[F.col(g).alias(f"_silt_{g}") for g in group], F.col("_silt_r").alias("_silt_q"), "_silt_b")
    inside = F.sum("_silt_v").over(Window.partitionBy(*group, "_silt_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_silt_v")
    same = F.col("_silt_r") == F.col("_silt_q")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_silt_{g}"))
    out = rows.withColumn("_silt_i", inside).join(F.broadcast(before), same)
    return out.select(*df.columns, (F.col("_silt_b") + F.col("_silt_i")).alias(name))
