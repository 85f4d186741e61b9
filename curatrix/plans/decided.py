"""Decisions from the event log, and the plans that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import decisions as D
from curatrix.operators import triage
from curatrix.operators.rules import resolved_policy
from curatrix.plans.base import FIND, SEVERITY, T1, L, M, decision_log, decisions, findings, items, query, triaged
from curatrix.schemas import DECISIONS
from curatrix.sources.shared import table

_D = f"{FIND}, {T1}, {L}"
_A = f"""{_D}, a AS (SELECT f.item_id, f.category, f.analyzer, f.severity, d.decision, CASE WHEN d.category IS NULL AND d.analyzer IS NULL THEN 2 WHEN d.category = f.category AND d.analyzer IS NULL THEN 1 WHEN d.category = f.category AND d.analyzer = f.analyzer THEN 0 END AS scope
  FROM f LEFT JOIN d USING (item_id)), b AS (SELECT item_id, category, analyzer, severity, arg_min(decision, scope) AS decision, min(scope) AS scope FROM a GROUP BY ALL)"""
_A = _A.replace("GROUP BY ALL", "GROUP BY item_id, category, analyzer, severity")
_W = "w AS (SELECT item_id, decision FROM d WHERE category IS NULL AND analyzer IS NULL)"


@query(f"WITH {L} SELECT item_id, category, analyzer, decision, event_id FROM d")
def latest_decision(spark, d):
    return decisions(spark, d).select("item_id", "category", "analyzer", "decision", "event_id")


@query(f"{_A} SELECT * FROM b")
def decision_fallback(spark, d):
    return D.applied(findings(spark, d), decisions(spark, d))


@query(f"{_D}, {_W} SELECT count(*) AS items, count(*) FILTER (decision <> 'UNDECIDED') AS reviewed, count(*) - count(*) FILTER (decision <> 'UNDECIDED') AS pending, round(100 * count(*) FILTER (decision <> 'UNDECIDED') / count(*), 1) AS pct FROM m LEFT JOIN w USING (item_id)")
def review_progress(spark, d):
    return D.progress(items(spark, d), D.image_level(decisions(spark, d)))


@query(f"""{_D}, {_W} SELECT item_id, bucket, n_findings FROM t LEFT JOIN w USING (item_id) WHERE coalesce(decision, 'UNDECIDED') = 'UNDECIDED'
ORDER BY CASE bucket WHEN 'PRIORITY_REVIEW' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, rank DESC, n_findings DESC, confidence DESC, item_id LIMIT 1""")
def next_action(spark, d):
    known = D.image_level(decisions(spark, d))
    t = triaged(spark, d).join(known, "item_id", "left").withColumn("decided", F.coalesce(F.col("decision") != "UNDECIDED", F.lit(False)))
    return triage.next_action(t).select("item_id", "bucket", "n_findings")


@query(f"WITH {L} SELECT s.decision, count(d.item_id) AS n FROM (SELECT unnest({list(DECISIONS)}) AS decision) s LEFT JOIN d ON d.decision = s.decision GROUP BY s.decision")
def decision_summary(spark, d):
    return D.summary(decisions(spark, d))


@query(f"""{_A} SELECT item_id, bucket, category, analyzer, severity, decision, CASE WHEN decision = 'UNDECIDED' THEN 'deferred' WHEN decision IN ('KEEP', 'ACCEPTED_STYLE_FALSE_POSITIVE') THEN 'suppressed' ELSE 'candidate' END AS status, 'Noise Consistency Review' AS suggestion
FROM b JOIN (SELECT item_id, bucket FROM t WHERE bucket <> 'READY_FOR_TRAINING') USING (item_id)""")
def improvement_plan(spark, d):
    return D.improvement_plan(findings(spark, d), triaged(spark, d), decisions(spark, d))


@query(f"""{_D}, {_W}, s AS (SELECT item_id, bool_or(category LIKE 'caption.%') AS caption FROM f GROUP BY item_id), o AS (SELECT item_id, confidence, decision, CASE WHEN decision IN ('KEEP', 'ACCEPTED_STYLE_FALSE_POSITIVE') THEN 'keep' WHEN decision = 'UNDECIDED' OR caption IS NULL THEN 'no_action' WHEN caption THEN 'manual_caption' ELSE 'replace_source' END AS operation FROM t LEFT JOIN s USING (item_id) LEFT JOIN w USING (item_id))
SELECT item_id, operation, CASE WHEN operation = 'no_action' THEN 'unknown' ELSE 'manual' END AS provider, CASE operation WHEN 'keep' THEN 'rejected' WHEN 'no_action' THEN 'not_available' ELSE 'ready' END AS status,
  CASE WHEN operation = 'keep' THEN 'rejected' WHEN operation = 'no_action' THEN 'not_requested' WHEN decision IN ('IMPROVEMENT_CANDIDATE', 'REMOVAL_CANDIDATE') THEN 'approved' ELSE 'not_requested' END AS approval, round(confidence, 4) AS confidence FROM o""")
def improvement_preview(spark, d):
    return D.improvement_preview(triaged(spark, d), findings(spark, d), decisions(spark, d))


@query(f"""WITH {L}, x AS (SELECT * FROM d WHERE category IS NULL), n AS (SELECT * FROM d WHERE category IS NOT NULL AND analyzer IS NULL)
SELECT item_id, category, decision FROM x WHERE item_id NOT IN (SELECT item_id FROM n) UNION ALL SELECT item_id, category, decision FROM n""")
def decision_upsert(spark, d):
    all_ = decisions(spark, d).select("item_id", "category", "decision", "analyzer")
    return D.upsert(all_.filter("category IS NULL"), all_.filter("category IS NOT NULL AND analyzer IS NULL")).select("item_id", "category", "decision")


@query(f"""WITH {L}, p AS (SELECT *, CASE decision WHEN 'REMOVAL_CANDIDATE' THEN 0 WHEN 'IMPROVEMENT_CANDIDATE' THEN 1 WHEN 'ACCEPTED_STYLE_FALSE_POSITIVE' THEN 2 WHEN 'KEEP' THEN 3 ELSE 4 END AS p FROM d)
SELECT item_id, first(decision ORDER BY p, coalesce(category, ''), coalesce(analyzer, '')) AS decision, count(*) AS entries, string_agg(decision, ',' ORDER BY p, coalesce(category, ''), coalesce(analyzer, '')) AS history, coalesce(string_agg('note ' || event_id, chr(10) ORDER BY event_id) FILTER (event_id % 3 = 0), '') AS notes FROM p GROUP BY item_id""")
def decision_migration(spark, d):
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), "event_id")).otherwise("")
    return D.migrated(decisions(spark, d).withColumns({"notes": note, "at": F.col("event_id")}))


_C = f"""WITH {L}, q AS (SELECT item_id, max(decision) FILTER (category IS NULL) AS action, max(decision) FILTER (category IS NOT NULL AND analyzer IS NULL) AS override, max(decision) FILTER (analyzer IS NOT NULL) AS locked_action FROM d GROUP BY item_id)"""


@query(f"{_C} SELECT item_id, coalesce(locked_action, override, action) AS effective_action, CASE WHEN locked_action IS NOT NULL THEN 'LOCKED' WHEN override IS NOT NULL THEN 'OVERRIDDEN' ELSE 'PENDING' END AS control_status FROM q")
def effective_action(spark, d):
    one = lambda c: F.max(F.when(c, F.col("decision")))
    plan = decisions(spark, d).groupBy("item_id").agg(one(F.col("category").isNull()).alias("action"), one(F.col("category").isNotNull() & F.col("analyzer").isNull()).alias("override"), one(F.col("analyzer").isNotNull()).alias("locked_action"))
    return D.effective_action(plan.withColumn("approval", F.lit(None).cast("string"))).select("item_id", "effective_action", "control_status")


@query(f"WITH {L} SELECT decision, count(*) AS n, count(DISTINCT item_id) AS items FROM l GROUP BY decision")
def decision_audit(spark, d):
    return decision_log(spark, d).groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


@query("SELECT n_name AS analyzer, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'hide' ELSE 'show' END AS display, 'run' AS execution FROM nation JOIN region ON n_regionkey = r_regionkey")
def policy_resolution(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    defaults = n.select(F.col("n_name").alias("analyzer"), F.lit("show").alias("display"), F.lit("run").alias("execution"))
    overrides = n.filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("n_name").alias("analyzer"), F.lit("hide").alias("display"))
    return resolved_policy(defaults, overrides)
