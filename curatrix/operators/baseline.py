"""Statistics of the whole dataset, or of each context group, that items are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.sources.shared import materialize


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, stddev (of the population), least and most of value, in all or by group; one pass with partial sums."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).cast("long").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("least"), F.max(v).alias("most"))


def index_percentiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """The value at place floor(n * p) of the sorted values, for each name and p in shares."""
    at = {name: F.least(F.floor(F.col("n") * p), F.col("n") - 1) for name, p in shares.items()}
    return at_places(df, value, at, *by)


def medians(df: DataFrame, value: str, *by: str, name: str = "median") -> DataFrame:
    """The exact median, the mean of the middle two of an even number of values."""
    two = at_places(df, value, {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.floor(F.col("n") / 2)}, *by)
    return two.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def at_places(df: DataFrame, value: str, places: dict[str, Column], *by: str) -> DataFrame:
    """The values at places (from 0, by `n`, the number of values) of the sorted values that aren't null, in all or by group.

    Values are counted first, and the counts range-partitioned, so neither a frequent value nor a group with very many
    values comes to one task: only the ranges that hold a place are summed value by value. No values: nulls (no rows by group).
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    rows = materialize(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "counts")
    sizes = rows.groupBy(*by, "_part").agg(F.sum("c").alias("c"))  # a row for each range, and for each group in it
    upto = Window.partitionBy(*by).orderBy("_part")
    ranges = sizes.withColumn("base", F.sum("c").over(upto) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    wanted = ranges.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("long").alias("at")) for k, v in places.items()))).alias("w"))
    hit = wanted.filter("base <= w.at AND w.at < base + c").select(*by, "_part", "base", "w.name", "w.at")
    inside = rows.join(hit, [*by, "_part"]).withColumn("_upto", F.col("base") + F.sum("c").over(Window.partitionBy(*by, "_part", "name").orderBy(value)))
    return inside.filter("_upto > at").groupBy(*by).agg(*(F.min(F.when(F.col("name") == k, F.col(value))).alias(k) for k in places))


def z_score(value: Column | str, mean: Column | str = "mean", stddev: Column | str = "stddev") -> Column:
    """Null where there is no spread to measure by."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(stddev) > 0, (c(value) - c(mean)) / c(stddev))


def against(df: DataFrame, stats: DataFrame, *by: str) -> DataFrame:
    """df with its baseline's columns. A single baseline is one row; those of groups are joined as Spark sees fit."""
    return df.crossJoin(F.broadcast(stats)) if not by else df.join(stats, list(by))


def total_variation(df: DataFrame, value: str, scale: float) -> Column:
    """Consistency of a distribution: 100 less its spread in units of scale, two digits; 100 for fewer than two values."""
    spread = F.stddev_pop(value)
    return F.when(F.count(value) < 2, F.lit(100.0)).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - spread / scale * 100)), 2))
