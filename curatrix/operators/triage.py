"""From findings to what a reviewer looks at first. Two policies exist on purpose; they disagree on a lone HIGH finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import ladder
from curatrix.schemas import SEVERITIES, rank_of, severity_of


def per_item(items: DataFrame, findings: DataFrame) -> DataFrame:
    """item_id, n_findings, n_categories, rank, confidence, error of every item, and of items that only findings name.

    Sums are partial on the map side; categories are counted as a set of the few that exist.
    """
    is_error = F.col("category").endswith(".error")
    sums = findings.groupBy("item_id").agg(F.count("*").alias("n_findings"), F.size(F.collect_set("category")).cast("long").alias("n_categories"), F.max(rank_of("severity")).alias("rank"), F.max("confidence").alias("confidence"), F.bool_or(is_error).alias("error"))
    both = items.select("item_id").distinct().join(sums, "item_id", "full_outer")
    return both.select("item_id", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), F.coalesce("n_categories", F.lit(0)).cast("long").alias("n_categories"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("error", F.lit(False)).alias("error"))


def buckets(per: DataFrame) -> DataFrame:
    """The triage bucket and its reason, by the first rule that holds."""
    reason = ladder((F.col("n_findings") == 0, "no_findings"), (F.col("error"), "analyzer_error"), (F.col("rank") >= SEVERITIES.index("HIGH"), "finding.high_severity"), (F.col("n_categories") >= 2, "finding.multiple_categories"), otherwise="finding.present")
    bucket = ladder((F.col("reason") == "no_findings", "READY_FOR_TRAINING"), (F.col("reason") == "finding.present", "NEEDS_REVIEW"), otherwise="PRIORITY_REVIEW")
    return per.withColumn("reason", reason).withColumn("bucket", bucket).withColumn("strongest", severity_of("rank"))


def queue_outcomes(per: DataFrame) -> DataFrame:
    """The review queue's outcome and priority."""
    outcome = ladder((F.col("n_findings") == 0, "no_attention_needed"), (F.col("error") | (F.col("n_categories") > 1), "priority_review"), otherwise="review_recommended")
    priority = ladder((F.col("n_findings") == 0, "none"), (F.col("error") | (F.col("n_categories") > 1), "high"), (F.col("rank") >= SEVERITIES.index("MEDIUM"), "medium"), otherwise="low")
    return per.withColumn("outcome", outcome).withColumn("priority", priority).withColumn("strongest", F.when(F.col("n_findings") > 0, severity_of("rank")))


def urgency(triaged: DataFrame, decided: str = "decided"):
    """The columns that order review work: undecided first, then by severity, count, confidence and id."""
    return [F.coalesce(F.col(decided), F.lit(False)).asc(), F.desc("rank"), F.desc("n_findings"), F.desc(F.when(F.isnan("confidence"), 0.0).otherwise(F.col("confidence"))), F.asc("item_id")]


#: The order of buckets.
BUCKETS = ("PRIORITY_REVIEW", "NEEDS_REVIEW", "READY_FOR_TRAINING")


def triage_order():
    """The columns that list a triaged dataset: by bucket, failed analyses first, then the strongest severity and the id."""
    return [F.array_position(F.lit(list(BUCKETS)), F.col("bucket")).asc(), F.desc("error"), F.desc("rank"), F.asc("item_id")]


def next_action(triaged: DataFrame) -> DataFrame:
    """One row: the most urgent undecided item of the first bucket that has any. A top-1, so partial on each task."""
    order = F.when(F.col("bucket") == "PRIORITY_REVIEW", 0).when(F.col("bucket") == "NEEDS_REVIEW", 1).otherwise(2)
    return triaged.filter("NOT decided").withColumn("place", order).orderBy("place", *urgency(triaged)).limit(1)
