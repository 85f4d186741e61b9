"""Reports as relations: one row of sums, one row for each line, item or analyzer; a sink writes them as JSON, text or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import evidence_text, ladder
from curatrix.operators.rollup import enumeration
from curatrix.schemas import SEVERITIES, rank_of, severity_of

#: What a triage bucket is called.
LABELS = {"READY_FOR_TRAINING": "No Findings Emitted", "NEEDS_REVIEW": "Needs Review", "PRIORITY_REVIEW": "Priority Review"}


def inspection_summary(items: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: findings, items with and without any, errors, and findings by severity."""
    per = findings.groupBy("item_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count_if(F.col("category").endswith(".error")).alias("errors"))
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"), F.count("*").alias("images_with_findings"), F.coalesce(F.sum("errors"), F.lit(0)).alias("analyzer_errors"), *(F.coalesce(F.sum(s), F.lit(0)).alias(s.lower()) for s in SEVERITIES))
    both = sums.crossJoin(F.broadcast(items.agg(F.count("*").alias("total_images"))))
    return both.select("total_images", "total_findings", "images_with_findings", (F.col("total_images") - F.col("images_with_findings")).alias("images_clean"), "analyzer_errors", *(s.lower() for s in SEVERITIES))


def finding_lines(findings: DataFrame, rate: Column) -> DataFrame:
    """item_id, category, analyzer, line: a finding as a report's text has it; rate: how often its rule is wrong."""
    sure = F.format_number("confidence", 2)  # rounds the double itself, as C does; %.2f rounds its shortest decimal, and 0.415 is below its half
    said = F.format_string("  [%s] %s — confidence %s (FP rate ~%d%%)", "severity", "category", sure, F.round(rate * 100).cast("int"))
    return findings.select("item_id", "category", "analyzer", said.alias("line"))


def evidence_line(entries: Column | str) -> Column:
    """The line of a finding's evidence, without what only the tool needs; empty if nothing is left."""
    kept = F.map_filter(entries, lambda k, v: k != "calibrated")
    return F.when(F.size(F.map_keys(kept)) > 0, F.concat(F.lit("  Evidence: "), evidence_text(kept))).otherwise("")


def recommendations(triaged: DataFrame, findings: DataFrame) -> DataFrame:
    """item_id, recommendation, display_label, primary_reason, reason_codes, finding_refs of each item, from its findings in order."""
    refs = findings.groupBy("item_id").agg(F.sort_array(F.collect_set(F.struct("analyzer", "category", "severity"))).alias("finding_refs"), F.sort_array(F.collect_set("category")).alias("categories"))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("bucket"))
    rows = triaged.join(refs, "item_id", "left")
    return rows.select("item_id", F.col("bucket").alias("recommendation"), label.alias("display_label"), F.col("reason").alias("primary_reason"), F.coalesce("categories", F.array().cast("array<string>")).alias("reason_codes"), "finding_refs")


def recommendation_counts(triaged: DataFrame) -> DataFrame:
    """One row: items, and those of each bucket."""
    is_one = lambda b: F.count_if(F.col("bucket") == b)
    return triaged.agg(F.count("*").alias("image_count"), is_one("READY_FOR_TRAINING").alias("ready_for_training_count"), is_one("NEEDS_REVIEW").alias("needs_review_count"), is_one("PRIORITY_REVIEW").alias("priority_review_count"))


def recommendation_lines(counts: DataFrame, categories: DataFrame) -> DataFrame:
    """place, line: the summary's head in Markdown. categories (category, n) are the few most common, in order of n."""
    named = categories.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category", "n"))).alias("c"))
    each = F.transform("c", lambda x: F.concat(F.lit("  - "), x["category"], F.lit(": "), x["n"].cast("string")))
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    head = F.array(F.lit("# Dataset Recommendation Summary"), F.lit(""), F.lit("## Dataset Summary"), F.lit(""), count("Images inspected", "image_count"), count("No Findings Emitted", "ready_for_training_count"), count("Needs Review", "needs_review_count"), count("Priority Review", "priority_review_count"), F.lit("- Most common finding categories:"))
    lines = counts.crossJoin(F.broadcast(named)).select(F.posexplode(F.concat(head, F.when(F.size("c") > 0, each).otherwise(F.array(F.lit("  - none"))))).alias("place", "line"))
    return lines.select((F.col("place") + 1).cast("long").alias("place"), "line")


def manifest_rows(analyzers: DataFrame, findings: DataFrame) -> DataFrame:
    """analyzers (analyzer, version, display) with findings and items of each: an inspection's provenance, one row an analyzer."""
    counts = findings.groupBy(F.split("analyzer", "/")[0].alias("analyzer")).agg(F.count("*").alias("finding_count"), F.countDistinct("item_id").alias("image_count"))
    rows = analyzers.join(counts, "analyzer", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("finding_count", "image_count")})


def comparison_lines(counts: DataFrame) -> DataFrame:
    """place, line: what changed between two runs, from one row of counts (columns in the order that is reported)."""
    each = F.array(*(F.concat(F.lit(f"{c.replace('_', ' ').capitalize()}: "), F.col(c).cast("string")) for c in counts.columns))
    return counts.select(F.posexplode(each).alias("place", "line")).select((F.col("place") + 1).cast("long").alias("place"), "line")


def workspace(items: DataFrame, triaged: DataFrame, findings: DataFrame, decisions: DataFrame, previews: DataFrame) -> DataFrame:
    """One row for each item: its recommendation, findings, decision and preview, from the sidecars that are there.

    An item only a report names, or only a recommendation, has a row as well; a decision on an item that neither names has none.
    """
    dossier = findings.groupBy("item_id").agg(F.count("*").alias("n_findings"), F.max(rank_of("severity")).alias("rank"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    both = items.select("item_id").join(triaged.select("item_id", F.col("bucket").alias("recommendation"), "reason"), "item_id", "full_outer")
    rows = both.join(dossier, "item_id", "left").join(decisions.select("item_id", "decision"), "item_id", "left").join(previews.select("item_id", "operation", "approval"), "item_id", "left")
    state = ladder((F.col("decision").isNull(), "pending"), (F.col("decision") == "UNDECIDED", "pending"), otherwise="reviewed")
    return rows.select("item_id", "recommendation", "reason", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), F.when(F.col("rank").isNotNull(), severity_of("rank")).alias("strongest"), F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("decision", F.lit("UNDECIDED")).alias("decision"), state.alias("state"), "operation", "approval")


def review_payload(workspace_: DataFrame, decisions: tuple[str, ...]) -> DataFrame:
    """section, name, n: the counts that head a review, of one pass over the workspace: buckets, decisions, states and operations."""
    sets = workspace_.withColumn("operation", F.coalesce("operation", F.lit("none"))).groupingSets([("recommendation",), ("decision",), ("state",), ("operation",)], "recommendation", "decision", "state", "operation")
    counts = sets.agg(F.count("*").alias("n"), F.grouping("recommendation").alias("a"), F.grouping("decision").alias("b"), F.grouping("state").alias("c"))
    section = ladder((F.col("a") == 0, "recommendation"), (F.col("b") == 0, "decision"), (F.col("c") == 0, "state"), otherwise="operation")
    named = counts.select(section.alias("section"), F.coalesce("recommendation", "decision", "state", "operation").alias("name"), "n")
    every = enumeration(workspace_, "name", decisions).withColumn("section", F.lit("decision")).unionByName(enumeration(workspace_, "name", tuple(LABELS)).withColumn("section", F.lit("recommendation")))
    known = named.join(every, ["section", "name"], "full_outer")
    return known.select("section", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines in order as text files under path: one for each range of the order, named in that order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_report(summary: DataFrame, findings: DataFrame, path: str) -> None:
    """An inspection's report as JSON lines: summary and findings, each a folder that spark.read.json takes back."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    findings.repartitionByRange("item_id").sortWithinPartitions("item_id", F.desc(rank_of("severity")), "category", "analyzer").write.mode("overwrite").json(f"{path}/findings")
