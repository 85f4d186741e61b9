"""Human decisions: the last word on each scope, the decision that applies to a finding, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import ladder
from curatrix.schemas import DECISIONS
from curatrix.operators.rollup import enumeration, zero_filled

SCOPE = ["item_id", "category", "analyzer"]
#: What is suggested for a category, and for any other.
SUGGESTIONS = {
    "texture.high_microtexture": "High Microtexture Review", "artifact.texture": "Texture Consistency Review", "artifact.crystalline_faceting": "Crystalline Faceting Review",
    "artifact.oversharpening_halo": "Oversharpening Review", "artifact.high_frequency_isolated": "Isolated High-Frequency Artifact Review", "texture.error": "Texture Consistency Review",
    "artifact.crystalline_faceting.error": "Texture Consistency Review", "artifact.oversharpening_halo.error": "Edge Consistency Review", "artifact.high_frequency_isolated.error": "Noise Consistency Review",
}
ANY_SUGGESTION = "Noise Consistency Review"


def latest(log: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last row of each scope (item, category, analyzer; null is a scope of its own): a maximum over structs."""
    rest = [c for c in log.columns if c not in SCOPE and c not in order]
    return log.groupBy(*SCOPE).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*SCOPE, "m.*")


def upsert(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """decisions with those of a changed item replaced."""
    return decisions.join(changes.select("item_id").distinct(), "item_id", "left_anti").unionByName(changes)


def applied(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings (item_id, category, analyzer, severity) with the decision that applies and its scope (0 the narrowest), or null.

    Candidates are joined by item and picked by a minimum, so a decision's item is shuffled once.
    """
    d = decisions.select("item_id", F.col("category").alias("dc"), F.col("analyzer").alias("da"), "decision")
    scope = ladder((F.col("dc").isNull() & F.col("da").isNull(), F.lit(2)), ((F.col("dc") == F.col("category")) & F.col("da").isNull(), F.lit(1)), ((F.col("dc") == F.col("category")) & (F.col("da") == F.col("analyzer")), F.lit(0)), otherwise=F.lit(None).cast("int"))
    both = findings.join(d, "item_id", "left").withColumn("scope", scope)
    keys = ["item_id", "category", "analyzer", "severity"]
    best = both.groupBy(*keys).agg(F.min(F.when(F.col("scope").isNotNull(), F.struct("scope", "decision"))).alias("m"))
    return best.select(*keys, F.col("m.decision").alias("decision"), F.col("m.scope").alias("scope"))


def image_level(decisions: DataFrame) -> DataFrame:
    """item_id, decision of decisions on whole items."""
    return decisions.filter("category IS NULL AND analyzer IS NULL").select("item_id", "decision")


def progress(items: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: items, reviewed, pending and the share reviewed; UNDECIDED is pending, and no items are wholly reviewed."""
    state = items.select("item_id").join(decided, "item_id", "left").select((F.coalesce(F.col("decision"), F.lit("UNDECIDED")) != "UNDECIDED").alias("done"))
    sums = state.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.col("done").cast("long")), F.lit(0)).cast("long").alias("reviewed"))
    return sums.select("items", "reviewed", (F.col("items") - F.col("reviewed")).alias("pending"), F.when(F.col("items") == 0, 100.0).otherwise(F.round(100 * F.col("reviewed") / F.col("items"), 1)).alias("pct"))


def summary(decisions: DataFrame) -> DataFrame:
    return zero_filled(decisions.groupBy("decision").agg(F.count("*").alias("n")), enumeration(decisions, "decision", DECISIONS), ["decision"])


def improvement_plan(findings: DataFrame, triaged: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each finding of an item that needs review: its suggestion, and whether it is a candidate, deferred or suppressed."""
    due = triaged.filter("bucket <> 'READY_FOR_TRAINING'").select("item_id", "bucket")
    named = applied(findings, decisions).join(due, "item_id")
    status = ladder((F.col("decision") == "UNDECIDED", "deferred"), (F.col("decision").isin("KEEP", "ACCEPTED_STYLE_FALSE_POSITIVE"), "suppressed"), otherwise="candidate")
    table = F.create_map(*(F.lit(x) for kv in SUGGESTIONS.items() for x in kv))
    return named.select("item_id", "bucket", "category", "analyzer", "severity", "decision", status.alias("status"), F.coalesce(F.try_element_at(table, F.col("category")), F.lit(ANY_SUGGESTION)).alias("suggestion"))


def improvement_preview(triaged: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """item_id, operation, provider, status, approval, confidence: a decision overrides, then the categories decide in order."""
    sets = findings.groupBy("item_id").agg(F.collect_set("category").alias("cats"))
    rows = triaged.select("item_id", "confidence").join(sets, "item_id", "left").join(image_level(decisions), "item_id", "left")
    any_of = lambda f: F.coalesce(F.exists("cats", f), F.lit(False))
    kept, open_ = F.col("decision").isin("KEEP", "ACCEPTED_STYLE_FALSE_POSITIVE"), F.col("decision") == "UNDECIDED"
    caption, copy = any_of(lambda c: c.startswith("caption.")), any_of(lambda c: c.isin("dataset.duplicate.exact", "duplicate.perceptual"))
    halo, encoding = any_of(lambda c: c == "artifact.oversharpening_halo"), any_of(lambda c: c.startswith("source_encoding."))
    kind = ladder((kept, "keep"), (open_, "no_action"), (F.col("cats").isNull(), "no_action"), (caption, "manual_caption"), (copy, "remove_duplicate"), (halo, "reduce_halo"), (encoding, "reduce_encoding_artifacts"), otherwise="replace_source")
    provider = ladder((F.col("operation") == "no_action", "unknown"), (F.col("operation").isin("reduce_halo", "reduce_encoding_artifacts"), "local_classical"), otherwise="manual")
    status = ladder((F.col("operation") == "keep", "rejected"), (F.col("operation") == "no_action", "not_available"), (F.col("provider") == "local_classical", "waiting_for_provider"), otherwise="ready")
    approval = ladder((F.col("operation") == "keep", "rejected"), (F.col("operation") == "no_action", "not_requested"), (F.col("decision").isin("IMPROVEMENT_CANDIDATE", "REMOVAL_CANDIDATE"), "approved"), otherwise="not_requested")
    return rows.withColumn("operation", kind).withColumn("provider", provider).withColumn("status", status).withColumn("approval", approval).select("item_id", "operation", "provider", "status", "approval", F.round("confidence", 4).alias("confidence"))


def effective_action(plan: DataFrame) -> DataFrame:
    """plan (action, override, locked_action, approval) with what holds: locked before overridden before generated."""
    chosen = F.coalesce("locked_action", "override", "action")
    status = ladder((F.col("locked_action").isNotNull(), "LOCKED"), (F.col("override").isNotNull(), "OVERRIDDEN"), otherwise=F.coalesce(F.col("approval"), F.lit("PENDING")))
    return plan.withColumn("effective_action", chosen).withColumn("control_status", status)


#: Of several entries for one item, which decision stands.
PRIORITY = {"REMOVAL_CANDIDATE": 0, "IMPROVEMENT_CANDIDATE": 1, "ACCEPTED_STYLE_FALSE_POSITIVE": 2, "KEEP": 3, "UNDECIDED": 4}


def migrated(legacy: DataFrame) -> DataFrame:
    """Item-level decisions from finding-level ones: the weightiest stands, the others are its history, in order.

    legacy: item_id, category, analyzer, decision and, if there are notes, notes and at, whose order they are joined in, a
    line each, without empty ones. Entries of an item are as many as its findings were.
    """
    order = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("decision")), F.lit(9))
    entry = F.struct(order.alias("p"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("analyzer", F.lit("")).alias("analyzer"), F.col("decision"))
    noted = {"at", "notes"} <= set(legacy.columns)
    notes = F.sort_array(F.collect_list(F.when(F.col("notes") != "", F.struct("at", "notes")))) if noted else F.array()
    found = legacy.groupBy("item_id").agg(F.array_sort(F.collect_list(entry)).alias("e"), notes.alias("_n"))
    said = F.array_join(F.transform("_n", lambda x: x["notes"]), "\n") if noted else F.lit("")
    return found.select("item_id", F.col("e")[0]["decision"].alias("decision"), F.size("e").cast("long").alias("entries"), F.array_join(F.transform("e", lambda x: x["decision"]), ",").alias("history"), said.alias("notes"))
