"""What changed between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["item_id", "category", "analyzer", "severity"]


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """After less before, as multisets."""
    return after.select(*KEY).exceptAll(before.select(*KEY))


def resolved_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select(*KEY).exceptAll(after.select(*KEY))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many findings both have, each as often as both do."""
    return before.select(*KEY).intersectAll(after.select(*KEY)).agg(F.count("*").alias("n"))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both whose value differs."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key).filter(~F.col("before").eqNullSafe(F.col("after")))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def count_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    a, b = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((before, "before"), (after, "after")))
    both = a.join(b, key, "full_outer").select(key, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("before", "after")))
    return both.withColumn("delta", F.col("after") - F.col("before"))


def provenance(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two analyzer manifests (name, version, policy): presence, version and policy, one row for each."""
    a, b = (x.select("name", F.col("version").alias(f"v{i}"), F.col("policy").alias(f"p{i}")) for i, x in enumerate((before, after)))
    both = a.join(b, "name", "full_outer")
    row = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.col(x).alias("before"), F.col(y).alias("after"))
    both_there = F.col("v0").isNotNull() & F.col("v1").isNotNull()
    rows = F.array_compact(F.array(
        F.when(F.col("v1").isNull(), row("removed", "v0", "v1")), F.when(F.col("v0").isNull(), row("added", "v0", "v1")),
        F.when(both_there & (F.col("v0") != F.col("v1")), row("version", "v0", "v1")), F.when(both_there & ~F.col("p0").eqNullSafe(F.col("p1")), row("policy", "p0", "p1")),
    ))
    return both.select("name", F.explode(rows).alias("r")).select("name", "r.kind", "r.before", "r.after")
