"""Baselines that are kept and merged: moments and a quantile sketch of each measure, updated without reading old records again.

A state has a row for each measure and group: n, errors (nulls, NaN and infinities), mean, m2 (the sum of squared deviations), least,
most and a sketch that counts values by logarithmic buckets. Counts, extremes and sketches of merged states are those of
the whole exactly, moments but for rounding (parallel variance, Chan et al.); a percentile is within a share ALPHA of the
value at its place (DDSketch, Masson et al.), of which baseline.index_percentiles is the exact form. Sketches grow with the
logarithm of the values' range, not with their number.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.sources.shared import drop_path, exists, listed, touch

ALPHA = 0.01
_LOG = math.log((1 + ALPHA) / (1 - ALPHA))
#: Added to a bucket's number, so that those of positive values are positive whatever the exponent.
_OFFSET = math.ceil(745 / _LOG) + 1


def bucket(value: Column) -> Column:
    """0 for 0; numbers of greater values are greater."""
    return (F.signum(value) * (F.ceil(F.log(F.abs(value)) / _LOG) + _OFFSET)).cast("int")


def _value(number: Column) -> Column:
    """The middle of a bucket, at most ALPHA of any value in it away."""
    return F.signum(number.cast("double")) * F.exp((F.abs(number) - _OFFSET) * _LOG) * (1 - ALPHA)


def state(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The state of df's measures, in all or by group. Values are counted by bucket first, with partial sums, so no group is gathered."""
    each = df.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("x")).select(*by, "x.*")
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    number = F.when(v == 0, 0).otherwise(bucket(v))
    counted = each.groupBy(*by, "measure", number.alias("b")).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("errors"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("least"), F.max(v).alias("most"))
    return _merged(counted.withColumn("sketch", F.when(F.col("b").isNotNull(), F.array(F.struct("b", "n")))).drop("b"), by)


def merge(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state of several (a union of their rows)."""
    return _merged(states, by)


def _merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "measure"]
    each = Window.partitionBy(*keys)  # of parts of states, and of no more buckets than there are
    weighed = F.when(F.col("n") > 0, F.col("n") * F.col("mean"))
    held = rows.withColumn("_mean", F.sum(weighed).over(each) / F.nullif(F.sum("n").over(each), F.lit(0)))
    off = F.when(F.col("n") > 0, F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    sums = held.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.max("_mean").alias("mean"), F.sum(off).alias("m2"), F.min("least").alias("least"), F.max("most").alias("most"))
    counts = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode("sketch").alias("s")).groupBy(*(f"_{k}" for k in keys), "s.b").agg(F.sum("s.n").alias("n"))
    sketches = counts.groupBy(*(f"_{k}" for k in keys)).agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("sketch"))  # as many as there are buckets
    return sums.join(sketches, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*keys, "n", "errors", "mean", "m2", "least", "most", "sketch")


def percentile(share: float) -> Column:
    """The middle of the bucket that holds the value at place floor(n * share), never outside of the least and the most."""
    place = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("b"))
    hit = F.aggregate("sketch", start, lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when(a["b"].isNull() & (a["upto"] + x["n"] > place), x["b"]).otherwise(a["b"]).alias("b")))
    return F.greatest("least", F.least("most", _value(hit["b"])))


def finish(states: DataFrame, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by, measure, n, errors, mean, stddev (of the population), least, most and each percentile. Measures without values have nulls."""
    return states.select(*by, "measure", "n", "errors", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("stddev"), "least", "most", *(percentile(p).alias(name) for name, p in shares.items()))


def _held(spark: SparkSession, path: str) -> tuple[dict[str, str], list[str]]:
    """Whole tables at path by batch or merger, and which batches mergers cover."""
    tables = {p.rsplit("/", 1)[1]: p for p in listed(spark, path) if exists(spark, f"{p}/_SUCCESS")}
    mergers = [p for name, p in tables.items() if name.startswith("merged-")]
    covered = [r.name for p in mergers for r in spark.read.json(f"{p}/covers", "name string").collect()] if mergers else []
    return tables, covered


def update(spark: SparkSession, path: str, batch: str, df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> None:
    """Adds the records of a batch to the baseline at path. A batch that is sent again replaces itself, or is left out where it was merged already."""
    if f"batch-{batch}" not in _held(spark, path)[1]:
        state(df, measures, by).write.mode("overwrite").parquet(f"{path}/batch-{batch}/state")
        touch(spark, f"{path}/batch-{batch}/_SUCCESS")


def load(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The state of all whole batches at path, those covered by a merger once."""
    tables, covered = _held(spark, path)
    parts = [p for name, p in tables.items() if name not in covered]
    if not parts:
        raise ValueError(f"no batch was added at {path}")
    return merge(spark.read.parquet(*(f"{p}/state" for p in parts)), by)


def compact(spark: SparkSession, path: str, by: Sequence[str] = ()) -> None:
    """Merges all batches into one table; what it covers is deleted once it is whole, and is never counted twice if that is cut short."""
    tables, covered = _held(spark, path)
    parts = [name for name in tables if name not in covered]
    to = f"{path}/merged-{max([0, *(int(n[7:]) for n in tables if n.startswith('merged-'))]) + 1}"
    load(spark, path, by).write.mode("overwrite").parquet(f"{to}/state")
    # earlier batches stay covered, should they be sent again
    names = sorted({*parts, *covered})
    spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").json(f"{to}/covers")
    touch(spark, f"{to}/_SUCCESS")
    for name in {*parts, *covered} & set(tables):
        drop_path(spark, tables[name])
