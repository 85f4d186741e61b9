"""Counts over findings: by category, severity, analyzer and item, with zeros where a dimension's value has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.semantics import ladder
from curatrix.schemas import SEVERITIES, rank_of, severity_of


def zero_filled(counts: DataFrame, dimension: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """counts for every row of a small dimension; 0 where counts has none."""
    return dimension.join(counts, keys, "left").withColumn(value, F.coalesce(value, F.lit(0)).cast("long"))


def enumeration(df: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def by_category_severity(findings: DataFrame) -> DataFrame:
    """A row for each severity of each category that has findings, from one aggregate."""
    counts = findings.groupBy("category").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES)))
    return counts.select("category", each.alias("s")).select("category", "s.severity", "s.n")


def one_pass(findings: DataFrame) -> DataFrame:
    """Counts by category, by severity, by analyzer and in all, from one scan: grouping sets."""
    sets = findings.groupingSets([("category",), ("severity",), ("analyzer",), ()], "category", "severity", "analyzer")
    return sets.agg(F.count("*").cast("long").alias("n"), F.grouping_id().cast("long").alias("level"))


def coverage(findings: DataFrame, analyzers: tuple[str, ...]) -> DataFrame:
    """Findings, items and categories of each analyzer, also of those that found nothing."""
    name = F.element_at(F.split("analyzer", "/"), 1)
    per = findings.withColumn("name", name).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    out = zero_filled(per, enumeration(findings, "name", analyzers), ["name"])
    return out.withColumn("items", F.coalesce("items", F.lit(0)).cast("long")).withColumn("categories", F.coalesce("categories", F.lit("")))


def top_categories(findings: DataFrame, k: int = 8) -> DataFrame:
    per = findings.groupBy("category").agg(F.count("*").alias("n"), F.max(rank_of("severity")).alias("r"))
    return per.orderBy(F.desc("n"), "category").limit(k).select("category", "n", severity_of("r").alias("strongest"))


def evidence_summary(findings: DataFrame, items: DataFrame, decided: DataFrame) -> DataFrame:
    """Findings, items, their share and the undecided among them, by category. decided: item_id of items with a decision."""
    per = findings.select("item_id", "category").groupBy("item_id", "category").agg(F.count("*").alias("n"))
    marked = per.join(decided.select("item_id").distinct().withColumn("d", F.lit(1)), "item_id", "left")
    sums = marked.groupBy("category").agg(F.sum("n").cast("long").alias("findings"), F.count("*").alias("items"), F.sum(F.when(F.col("d").isNull(), 1).otherwise(0)).cast("long").alias("undecided"))
    return sums.crossJoin(F.broadcast(items.agg(F.count("*").alias("total")))).withColumn("pct", F.round(100 * F.col("items") / F.col("total"), 1)).drop("total")


def families(findings: DataFrame, items: DataFrame) -> DataFrame:
    """How many items have no finding, an error, several categories, or which one."""
    per = findings.groupBy("item_id").agg(F.min("category").alias("c"), F.max("category").alias("d"), F.bool_or(F.col("category").endswith(".error")).alias("e"))
    label = ladder((F.col("c").isNull(), "none"), (F.col("e"), "errors"), (F.col("c") != F.col("d"), "multiple"), otherwise=F.col("c"))
    return items.select("item_id").join(per, "item_id", "left").groupBy(label.alias("family")).agg(F.count("*").alias("n"))


def dominant(findings: DataFrame) -> DataFrame:
    """place, category, n: categories that aren't of failed analyses, the most frequent first, of equals by name."""
    per = findings.filter(~F.endswith("category", F.lit(".error"))).groupBy("category").agg(F.count("*").alias("n"))
    return per.select(F.row_number().over(Window.orderBy(F.desc("n"), "category")).cast("long").alias("place"), "category", "n")  # of few categories


def dataset_summary(findings: DataFrame, items: DataFrame) -> DataFrame:
    """One row: items, those with and without findings, failed analyses, and the dominant categories in order."""
    with_any = findings.agg(F.count_distinct("item_id").alias("with_findings"), F.count_if(F.endswith("category", F.lit(".error"))).alias("errors"))
    names = dominant(findings).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "category"))), lambda x: x["category"]), ",").alias("dominant"))
    sums = items.agg(F.count("*").alias("items")).crossJoin(with_any).crossJoin(names)  # one row each
    return sums.select("items", "with_findings", (F.col("items") - F.col("with_findings")).alias("without_findings"), "errors", "dominant")


def contribution(covered: DataFrame, manifest: DataFrame) -> DataFrame:
    """analyzer, version, family, finding_count, image_count, calibration, source of each analyzer that either table names.

    What the manifest says holds, a coverage row fills in what it doesn't (covered has no family).
    """
    c, m = covered.withColumnsRenamed({x: f"c_{x}" for x in covered.columns if x != "analyzer"}), manifest.withColumnsRenamed({x: f"m_{x}" for x in manifest.columns if x != "analyzer"}).withColumn("_m", F.lit(True))
    first = lambda name, default: F.coalesce(f"m_{name}", f"c_{name}", F.lit(default)).alias(name)
    version = F.coalesce(F.nullif("m_version", F.lit("")), F.nullif("c_version", F.lit("")), F.lit(""))
    return c.join(m, "analyzer", "full_outer").select(
        "analyzer", version.alias("version"), F.coalesce("m_family", F.lit("not recorded")).alias("family"), first("finding_count", 0), first("image_count", 0), first("calibration", "advisory fallback"),
        F.when(F.col("_m"), "inspection_manifest").otherwise("recommendation_summary").alias("source"),
    )


def dossiers(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each item with findings: its findings in order, nested, and its decision."""
    nested = findings.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("category", "analyzer", "severity", "confidence"))).alias("findings"))
    return nested.join(decisions, "item_id", "left")
