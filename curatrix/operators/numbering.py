"""Consecutive numbers in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.sources.shared import materialize

_PART = "shiftrightunsigned(_id, 33)"  # monotonically_increasing_id keeps the partition above, the row's place below


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with its row's place, from 1, in the order.

    Rows are range-partitioned and sorted once, and numbered where they stand; what is summed has a row for each partition.
    """
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    sizes = rows.groupBy(F.expr(_PART).alias("_part")).agg(F.count("*").alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    placed = rows.withColumn("_part", F.expr(_PART)).join(F.broadcast(base), "_part")
    return placed.withColumn(name, F.expr("_base + (_id & 8589934591) + 1").cast("long")).drop("_part", "_id", "_base")
