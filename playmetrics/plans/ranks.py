"""Ranks and running totals over a whole table in a global order.

A window without keys would put all rows into one task.  Here the rows are dealt into ranges of the order,
each range is summed, and the sums of the ranges before (one number per partition) are added
to the running total inside a range.  Order columns may have any type that Spark can sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle


def running_total(df: DataFrame, order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (an integer) over all rows before this one in ``order``.

    Nulls come first.  Rows that tie in ``order`` are counted one after the other, in no stated order,
    and meet in one task: reduce them to one row with a weight before.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = settle(ranged.withColumn("_weight", weight.cast("bigint")), "ranges")
    sums = sorted(placed.groupBy("_range").agg(F.sum("_weight").alias("s")).collect(), key=lambda r: r["_range"])
    before = accumulate((r["s"] or 0 for r in sums), initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(r["_range"], b) for r, b in zip(sums, before)], "_range int, _offset bigint"
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Dealt by hash, several ranges would meet in one task.
    apart = placed.repartitionByRange(max(len(sums), 2), "_range")
    counted = apart.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return (
        counted.join(offsets, "_range")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_range", "_weight", "_inside", "_offset")
    )
