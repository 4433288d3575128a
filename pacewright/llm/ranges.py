"""Running totals over a global order without gathering it in one task.

Rows are dealt out by range and written; each partition has its sum, and the sums of the partitions before it,
one number a partition, are what a partition adds to its own running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewright.llm.shared import written

_IN_PARTITION = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def with_totals_before(df: DataFrame, order: list[Column], value: str | None = None, name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of ``value`` (1 if not given) over all rows that come before in ``order``.

    ``order`` tells rows apart, or leaves equal rows in any order, each with a place of its own.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = written(laid.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))}), "ordered")
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    own = F.col("_at") if value is None else F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = laid.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    # one row per partition
    earlier = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_part", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    return laid.join(sums, "_part").withColumn(name, F.col("_earlier") + own).drop("_part", "_at", "_earlier")
