"""Predictions held against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import ladder, ratio


def confusion(df: DataFrame, *by: str, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1, fpr (six digits, 0 where undefined), in one pass."""
    p, a = F.col(predicted), F.col(actual)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = df.groupBy(*by).agg(count(p & a).alias("tp"), count(p & ~a).alias("fp"), count(~p & a).alias("fn"), count(~p & ~a).alias("tn"))
    return with_ratios(out)


def with_ratios(out: DataFrame, digits: int = 6, empty: float | None = 0.0) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumn("precision", ratio(tp, tp + fp, digits, empty)).withColumn("recall", ratio(tp, tp + fn, digits, empty)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn, digits, empty)).withColumn("fpr", ratio(fp, fp + tn, digits, empty))


def against_labels(labels: DataFrame, predictions: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """item_id, category, actual, predicted for each labelled item and category; predictions of unlabelled items don't count.

    labels: item_id and, as an array, the categories it should have. predictions: (item_id, category).
    """
    per = predictions.filter(F.col("category").isin(*categories)).groupBy("item_id").agg(F.collect_set("category").alias("found"))
    both = labels.join(per, "item_id", "left")
    each = F.explode(F.array(*map(F.lit, categories)))
    rows = both.select("item_id", "categories", F.coalesce("found", F.array().cast("array<string>")).alias("found"), each.alias("category"))
    return rows.select("item_id", "category", F.array_contains("categories", F.col("category")).alias("actual"), F.array_contains("found", F.col("category")).alias("predicted"))


def per_analyzer(marked: DataFrame, analyzer_of: Column) -> DataFrame:
    """Confusion of analyzers: any of its categories, on both sides."""
    some = marked.withColumn("analyzer", analyzer_of).groupBy("analyzer", "item_id").agg(F.bool_or("actual").alias("actual"), F.bool_or("predicted").alias("predicted"))
    return confusion(some, "analyzer")


def threshold_sweep(df: DataFrame, z: str, actual: str, thresholds: list[float], floor: Column | None = None) -> DataFrame:
    """Confusion at each threshold (four digits, null where undefined): the data is read once, each row meeting the few thresholds."""
    each = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    hit = F.coalesce(F.col(z) >= F.col("threshold"), F.lit(False))
    out = confusion(each.withColumn("predicted", hit if floor is None else hit & floor).withColumn("actual", F.col(actual)), "threshold")
    return with_ratios(out.select("threshold", "tp", "fp", "fn", "tn"), 4, None).drop("fpr")


def readiness(confused: DataFrame, disagreement: Column | None = None) -> DataFrame:
    """The first gate that a category doesn't pass."""
    n, pos, neg = F.expr("tp + fp + fn + tn"), F.expr("tp + fn"), F.expr("fp + tn")
    return confused.withColumn("status", ladder(
        ((n < 10) | (pos < 3) | (neg < 3), "insufficient_evidence"), (F.lit(False) if disagreement is None else disagreement, "review_disagreement"),
        ((F.col("fp") > 0) & ((F.col("precision") < 0.95) | (F.col("fpr") > 0.05)), "false_positive_risk"), ((F.col("fn") > 0) & (F.col("recall") < 0.90), "false_negative_risk"), otherwise="ready",
    ))


def examples(marked: DataFrame, kind: str) -> DataFrame:
    """Items that were predicted without being labelled (fp) or labelled without being predicted (fn)."""
    return marked.filter("predicted AND NOT actual" if kind == "fp" else "actual AND NOT predicted").select("item_id", "category")


def effect_size(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Cohen's d by both conventions: pooled sample variance (0 under two values), and mean population variance (null)."""
    side = lambda y: F.when(F.col(flag) == y, F.col(value))
    s = df.agg(*(f(side(y)).alias(f"{n}{y}") for y in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("vs", F.var_samp), ("vp", F.var_pop))))
    few = (F.col("n0") < 2) | (F.col("n1") < 2)
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("vs1") + (F.col("n0") - 1) * F.col("vs0")) / (F.col("n0") + F.col("n1") - 2))
    mean = F.sqrt((F.col("vp1") + F.col("vp0")) / 2)
    d = F.col("m1") - F.col("m0")
    return s.select("n0", "n1", F.when(few | (pooled == 0), 0.0).otherwise(F.round(d / pooled, 6)).alias("d_pooled"), F.when(few | (mean <= 1e-9), F.lit(None).cast("double")).otherwise(F.round(d / mean, 3)).alias("d_mean"))


def agreement(df: DataFrame, finding: str, verdict: str) -> DataFrame:
    """FINDING or CLEAN by AGREE, DISAGREE or UNSURE, one row each side."""
    side = F.when(F.col(finding), "FINDING").otherwise("CLEAN")
    count = lambda v: F.sum(F.when(F.col(verdict) == v, 1).otherwise(0)).cast("long").alias(v.lower())
    return df.groupBy(side.alias("side")).agg(*map(count, ("AGREE", "DISAGREE", "UNSURE")))


def containment(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expectations (id, should_detect, expected_severity) with PASS, FAIL or SKIP, by the first finding observed (id, severity)."""
    first = observed.groupBy("id").agg(F.min("severity").alias("severity"))
    both = expected.join(first, "id", "left")
    found = F.col("severity").isNotNull()
    result = ladder((F.col("should_detect").isNull(), "SKIP"), (F.col("should_detect") != found, "FAIL"), (found & F.col("expected_severity").isNotNull() & (F.col("expected_severity") != F.col("severity")), "FAIL"), otherwise="PASS")
    return both.withColumn("result", result)
