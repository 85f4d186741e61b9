"""Reports, the review workspace, and plans under control, over documents and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import controls, reports
from curatrix.operators import decisions as D
from curatrix.operators.baseline import against, statistics, z_score
from curatrix.operators.rollup import top_categories
from curatrix.operators.rules import z_severity
from curatrix.plans.base import F1, F2, FIND, L, M, RANK, SEVERITY, T1, T2, V2, Z, decisions, findings, items, query, triaged
from curatrix.schemas import DECISIONS
from curatrix.sources.shared import table


@query(f"""{FIND} SELECT (SELECT count(*) FROM m) AS total_images, count(*) AS total_findings, count(DISTINCT item_id) AS images_with_findings, (SELECT count(*) FROM m) - count(DISTINCT item_id) AS images_clean, count(*) FILTER (category LIKE '%.error') AS analyzer_errors,
  count(*) FILTER (severity = 'NONE') AS none, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'CRITICAL') AS critical FROM f""")
def inspection_summary(spark, d):
    return reports.inspection_summary(items(spark, d), findings(spark, d))


@query(f"{FIND} SELECT item_id, category, analyzer, '  [' || severity || '] ' || category || ' — confidence ' || printf('%.2f', confidence) || ' (FP rate ~35%)' AS line FROM f")
def report_lines(spark, d):
    return reports.finding_lines(findings(spark, d), F.lit(0.35))


@query(f"""{FIND}, {T1}, r AS (SELECT item_id, list_sort(list(DISTINCT category)) AS codes FROM f GROUP BY item_id) SELECT item_id, bucket AS recommendation, CASE bucket WHEN 'READY_FOR_TRAINING' THEN 'No Findings Emitted' WHEN 'NEEDS_REVIEW' THEN 'Needs Review' ELSE 'Priority Review' END AS display_label,
  reason AS primary_reason, coalesce(array_to_string(codes, '|'), '') AS reason_codes FROM t LEFT JOIN r USING (item_id)""")
def recommendation_rows(spark, d):
    r = reports.recommendations(triaged(spark, d), findings(spark, d))
    return r.select("item_id", "recommendation", "display_label", "primary_reason", F.array_join("reason_codes", "|").alias("reason_codes"))


@query(f"""{FIND}, {T1}, a AS (SELECT count(*) AS n, count(*) FILTER (bucket = 'READY_FOR_TRAINING') AS r, count(*) FILTER (bucket = 'NEEDS_REVIEW') AS v, count(*) FILTER (bucket = 'PRIORITY_REVIEW') AS p FROM t), tc AS (SELECT category, count(*) AS n FROM f GROUP BY category ORDER BY n DESC, category LIMIT 8),
l AS (SELECT ['# Dataset Recommendation Summary', '', '## Dataset Summary', '', '- Images inspected: ' || n, '- No Findings Emitted: ' || r, '- Needs Review: ' || v, '- Priority Review: ' || p, '- Most common finding categories:'] || coalesce((SELECT list('  - ' || category || ': ' || n ORDER BY n DESC, category) FROM tc), ['  - none']) AS t FROM a)
SELECT CAST(unnest(range(1, len(t) + 1)) AS BIGINT) AS place, unnest(t) AS line FROM l""")
def recommendation_summary(spark, d):
    return reports.recommendation_lines(reports.recommendation_counts(triaged(spark, d)), top_categories(findings(spark, d)))


@query(f"{FIND} SELECT a.analyzer, 'v1' AS version, a.display, count(item_id) AS finding_count, count(DISTINCT item_id) AS image_count FROM (SELECT unnest(['caption', 'length', 'texture']) AS analyzer, unnest(['show', 'show', 'hide']) AS display) a LEFT JOIN f ON split_part(f.analyzer, '/', 1) = a.analyzer GROUP BY a.analyzer, a.display")
def inspection_manifest(spark, d):
    analyzers = spark.createDataFrame([("caption", "v1", "show"), ("length", "v1", "show"), ("texture", "v1", "hide")], "analyzer string, version string, display string")
    return reports.manifest_rows(analyzers, findings(spark, d))


@query(f"""WITH {M}, {Z}, {F1}, {F2}, {T1}, {T2}, k AS (SELECT (SELECT count(*) FROM f) AS a, (SELECT count(*) FROM f2) AS b, (SELECT count(*) FROM t JOIN t2 USING (item_id) WHERE t.bucket <> t2.bucket) AS c)
SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS place, unnest(['Findings before: ' || a, 'Findings after: ' || b, 'Changed recommendations: ' || c]) AS line FROM k""")
def comparison_summary(spark, d):
    before, after = triaged(spark, d), triaged(spark, d, V2)
    both = before.select("item_id", "bucket", "n_findings").join(after.select("item_id", F.col("bucket").alias("b2"), F.col("n_findings").alias("n2")), "item_id")
    counts = both.agg(F.sum("n_findings").alias("findings_before"), F.sum("n2").alias("findings_after"), F.count_if(F.col("bucket") != F.col("b2")).alias("changed_recommendations"))
    return reports.comparison_lines(counts)


_WS = f"""{FIND}, {T1}, {L}, w AS (SELECT item_id, decision FROM d WHERE category IS NULL AND analyzer IS NULL), s AS (SELECT item_id, bool_or(category LIKE 'caption.%') AS caption FROM f GROUP BY item_id), o AS (SELECT item_id, decision, CASE WHEN decision IN ('KEEP', 'ACCEPTED_STYLE_FALSE_POSITIVE') THEN 'keep' WHEN decision = 'UNDECIDED' OR caption IS NULL THEN 'no_action' WHEN caption THEN 'manual_caption' ELSE 'replace_source' END AS operation FROM t LEFT JOIN s USING (item_id) LEFT JOIN w USING (item_id)),
v AS (SELECT item_id, operation, CASE WHEN operation = 'keep' THEN 'rejected' WHEN operation = 'no_action' THEN 'not_requested' WHEN decision IN ('IMPROVEMENT_CANDIDATE', 'REMOVAL_CANDIDATE') THEN 'approved' ELSE 'not_requested' END AS approval FROM o),
q AS (SELECT item_id, max({RANK}) AS rank, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM f GROUP BY item_id),
ws AS (SELECT t.item_id, bucket AS recommendation, reason, n_findings, CASE WHEN q.rank IS NOT NULL THEN {SEVERITY}[q.rank + 1] END AS strongest, coalesce(categories, '') AS categories, coalesce(w.decision, 'UNDECIDED') AS decision, CASE WHEN coalesce(w.decision, 'UNDECIDED') = 'UNDECIDED' THEN 'pending' ELSE 'reviewed' END AS state, operation, approval
  FROM t LEFT JOIN q USING (item_id) LEFT JOIN w USING (item_id) LEFT JOIN v USING (item_id))"""


def _workspace(spark, d):
    t, f, known = triaged(spark, d), findings(spark, d), decisions(spark, d)
    return reports.workspace(items(spark, d), t, f, D.image_level(known), D.improvement_preview(t, f, known))


@query(f"{_WS} SELECT * FROM ws")
def review_workspace(spark, d):
    return _workspace(spark, d)


@query(f"""{_WS}, pc AS (SELECT 'recommendation' AS section, recommendation AS name, count(*) AS n FROM ws GROUP BY recommendation UNION ALL SELECT 'decision', decision, count(*) FROM ws GROUP BY decision UNION ALL SELECT 'state', state, count(*) FROM ws GROUP BY state UNION ALL SELECT 'operation', coalesce(operation, 'none'), count(*) FROM ws GROUP BY 2)
SELECT section, name, n FROM pc UNION ALL SELECT 'decision', x, 0 FROM (SELECT unnest({list(DECISIONS)}) AS x) WHERE x NOT IN (SELECT name FROM pc WHERE section = 'decision') UNION ALL SELECT 'recommendation', x, 0 FROM (SELECT unnest({list(reports.LABELS)}) AS x) WHERE x NOT IN (SELECT name FROM pc WHERE section = 'recommendation')""")
def review_payload(spark, d):
    return reports.review_payload(_workspace(spark, d), DECISIONS)


#: Customers' orders stand for commands on a plan of customers: their status and priority say which.
_COMMAND = "CASE o_orderkey % 5 WHEN 0 THEN 'override' WHEN 1 THEN 'lock' WHEN 2 THEN 'unlock' WHEN 3 THEN 'approve' ELSE 'reject' END"
_VALUE = "CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'CLEAN_LIGHT' WHEN 1 THEN 'KEEP' WHEN 2 THEN 'CLEAN_STRONG' ELSE 'CAPTION_ONLY' END WHEN o_orderkey % 10 = 1 THEN 'CLEAN_MEDIUM' END"
_ACTION = "CASE c_custkey % 4 WHEN 0 THEN 'CLEAN_LIGHT' WHEN 1 THEN 'CLEAN_MEDIUM' WHEN 2 THEN 'KEEP' ELSE 'MANUAL_REVIEW' END"


#: What comes last of all in a plan that is resolved: each decision is approved, or every third rejected.
_LAST = "SELECT c_custkey AS item_id, 1000000000000 + c_custkey AS at, CASE WHEN c_custkey % 3 = 0 THEN 'reject' ELSE 'approve' END AS command, CAST(NULL AS STRING) AS value FROM customer"


def _controlled(spark, d, command=_COMMAND, resolved=False):
    customers = table(spark, d, "customer")
    plan = customers.selectExpr("c_custkey AS item_id", f"{_ACTION} AS action")
    log = table(spark, d, "orders").selectExpr("o_custkey AS item_id", "o_orderkey AS at", f"{command} AS command", f"{_VALUE} AS value")
    return controls.controlled(plan, log.unionByName(spark.sql(_LAST.replace("FROM customer", "FROM {customer}"), customer=customers)) if resolved else log)


_LOG = f"SELECT o_custkey AS item_id, o_orderkey AS seq, {_COMMAND} AS command, {_VALUE} AS value FROM orders"
_CTL = f"""WITH g AS ({_LOG}), h AS (SELECT *, coalesce(last_value(CASE command WHEN 'lock' THEN true WHEN 'unlock' THEN false END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM g),
e AS (SELECT *, NOT held OR command IN ('unlock', 'approve') AS done FROM h), k AS (SELECT item_id, arg_max(value, seq) FILTER (done AND value IS NOT NULL) AS override, arg_max(CASE command WHEN 'reject' THEN 'rejected' ELSE 'approved' END, seq) FILTER (done AND command IN ('approve', 'reject', 'lock')) AS approval,
  arg_max(command = 'lock', seq) FILTER (done AND command IN ('lock', 'unlock')) AS locked, count(*) FILTER (NOT done) AS refused FROM e GROUP BY item_id),
x AS (SELECT c_custkey AS item_id, {_ACTION} AS generated_action, coalesce(override, {_ACTION}) AS action, coalesce(approval, 'proposed') AS approval, override IS NOT NULL AS overridden, coalesce(locked, false) AS locked, coalesce(refused, 0) AS refused FROM customer LEFT JOIN k ON c_custkey = item_id),
ct AS (SELECT *, CASE WHEN locked THEN 'locked' WHEN overridden THEN 'overridden' ELSE approval END AS status, approval = 'approved' OR locked AS eligible FROM x)"""


@query(f"{_CTL} SELECT item_id, generated_action, action, approval, overridden, locked, refused, status, eligible FROM ct")
def plan_controls(spark, d):
    return _controlled(spark, d).select("item_id", "generated_action", "action", "approval", "overridden", "locked", "refused", "status", "eligible")


_RESET = _COMMAND.replace("CASE o_orderkey", "CASE WHEN o_orderkey % 1001 = 1000 THEN 'reset' ELSE CASE o_orderkey") + " END"


@query(f"{_CTL.replace(_LOG, f'SELECT * FROM ({_LOG}) WHERE seq > coalesce((SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 1001 = 1000), -1)')} SELECT item_id, generated_action, action, approval, overridden, locked, refused, status, eligible FROM ct")
def plan_controls_after_reset(spark, d):
    return _controlled(spark, d, _RESET).select("item_id", "generated_action", "action", "approval", "overridden", "locked", "refused", "status", "eligible")


@query(f"""{_CTL} SELECT item_id % 400 AS plan, count(*) AS decisions, count(*) FILTER (approval = 'proposed' AND NOT locked) AS unresolved, count(*) FILTER (approval = 'proposed' AND NOT locked) = 0 AS allowed,
  CASE WHEN count(*) FILTER (approval = 'proposed' AND NOT locked) = 0 THEN '' ELSE 'The approved cleanup plan is incomplete. Approve, reject, or lock every decision before expensive or destructive execution.' END AS reason FROM ct GROUP BY 1""")
def plan_gate(spark, d):
    """Of four hundred plans, which may be carried out."""
    return controls.gate(_controlled(spark, d).withColumn("plan", F.col("item_id") % 400), "plan")


@query(f"{_CTL} SELECT count(*) AS decisions, count(*) FILTER (approval = 'approved') AS approved, count(*) FILTER (approval = 'rejected') AS rejected, count(*) FILTER (locked) AS locked, bool_and(approval IN ('approved', 'rejected') OR locked) AS complete FROM ct")
def plan_control_summary(spark, d):
    return controls.control_summary(_controlled(spark, d))


@query(f"""{_CTL.replace(_LOG, f"{_LOG} UNION ALL {_LAST}")}, y AS (SELECT item_id, action, CASE WHEN action NOT IN ('CLEAN_LIGHT', 'CLEAN_MEDIUM', 'CLEAN_STRONG', 'CAPTION_ONLY') THEN 'action not eligible for execution: ' || action WHEN approval = 'rejected' THEN 'decision rejected' WHEN NOT eligible THEN 'decision not approved or locked'
  WHEN item_id % 10 = 9 THEN 'source not found' WHEN item_id % 7 = 0 AND action = 'CLEAN_LIGHT' THEN 'already completed (resume)' END AS reason FROM ct), n AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY item_id) AS place FROM y)
SELECT item_id, action, CASE WHEN reason = 'source not found' THEN 'failed' WHEN reason IS NULL AND place <= 20 THEN 'dry-run' ELSE 'skipped' END AS status, CASE WHEN reason IS NOT NULL THEN reason WHEN place <= 20 THEN 'dry-run: no files written' ELSE 'execution limit reached' END AS reason FROM n""")
def plan_execution(spark, d):
    """Of a resolved plan; the plan before it was resolved is refused."""
    plan = _controlled(spark, d, resolved=True)
    sources = table(spark, d, "customer").filter("c_custkey % 10 <> 9").selectExpr("c_custkey AS item_id")
    previous = table(spark, d, "customer").filter("c_custkey % 7 = 0").selectExpr("c_custkey AS item_id", "'CLEAN_LIGHT' AS action")
    return controls.execution(plan, sources, previous, limit=20)


_UP = "SELECT CAST(user_id AS VARCHAR) AS item_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'rejected' ELSE event_type END AS state, event_id AS seq FROM events"
_PV = "SELECT CAST(c_custkey AS VARCHAR) AS item_id, 'not_requested' AS approval FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'pending' FROM customer WHERE c_custkey % 9 = 0"
_UPD = f"WITH u AS ({_UP}), p AS ({_PV}), n AS (SELECT item_id, count(*) AS n FROM p GROUP BY item_id), j AS (SELECT u.*, CASE WHEN state NOT IN ('not_requested', 'pending', 'approved', 'rejected') THEN 'unknown state' WHEN n IS NULL THEN 'no preview' WHEN n > 1 THEN 'ambiguous' ELSE 'updated' END AS outcome FROM u LEFT JOIN n USING (item_id))"


def _updated(spark, d):
    e = table(spark, d, "events").selectExpr("CAST(user_id AS string) AS item_id", "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'rejected' ELSE event_type END AS state", "event_id AS at")
    c = table(spark, d, "customer")
    p = c.selectExpr("CAST(c_custkey AS string) AS item_id", "'not_requested' AS approval").unionByName(c.filter("c_custkey % 9 = 0").selectExpr("CAST(c_custkey AS string) AS item_id", "'pending' AS approval"))
    return controls.approvals_updated(p, e)


@query(f"{_UPD}, l AS (SELECT item_id, arg_max(state, seq) AS s FROM j WHERE outcome = 'updated' GROUP BY item_id) SELECT item_id, coalesce(s, approval) AS approval FROM p LEFT JOIN l USING (item_id)")
def preview_approvals(spark, d):
    return _updated(spark, d)[0]


@query(f"{_UPD} SELECT outcome, count(*) AS n FROM j GROUP BY outcome")
def preview_approval_outcomes(spark, d):
    return _updated(spark, d)[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {M}, {Z}, r AS (SELECT item_id, z, CASE WHEN z >= 2 THEN 'HIGH' WHEN z >= 1 THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM z), a AS (SELECT 'A' AS "group", item_id, z FROM r WHERE severity = 'HIGH' ORDER BY z DESC, item_id LIMIT 5), b AS (SELECT 'B', item_id, z FROM r WHERE severity = 'MEDIUM' ORDER BY z DESC, item_id LIMIT 5),
gc AS (SELECT 'C', item_id, z FROM r WHERE item_id NOT IN (SELECT item_id FROM a UNION ALL SELECT item_id FROM b) ORDER BY abs(z - 1), item_id LIMIT 5), e AS (SELECT 'D', item_id, z FROM r WHERE severity = 'NONE' ORDER BY z, item_id LIMIT 5), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM gc UNION ALL SELECT * FROM e)
SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY CASE WHEN "group" = 'D' THEN z ELSE -z END, item_id) AS place, item_id FROM u""")
def gallery_lists(spark, d):
    have = items(spark, d).select("item_id", "n_tokens")
    held = against(have, statistics(have, "n_tokens")).withColumn("z", z_score("n_tokens"))
    severity = F.when(F.col("z") >= 3, "HIGH").otherwise(z_severity(F.col("z")))
    return controls.capped_gallery(held, severity, F.col("z"))
