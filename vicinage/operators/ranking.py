"""Global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.store import once


def cumulative(df: DataFrame, by: str, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add `out`: the total of `value` over all rows of the same keys up to and with the row, in the order of `by`, which must be unique in a key.

    Rows are dealt by ranges of (keys, by), summed up inside each range, and moved up by the totals of the
    ranges before; the one-task window sees a row for each range and key.
    """
    order = [*keys, by]
    ranged = once(df.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_r").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_r", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_r").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, [*keys, "_r"]).withColumn(out, F.col("_o") + F.sum(value).over(inside)).drop("_r", "_o")
