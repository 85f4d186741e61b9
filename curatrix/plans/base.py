"""What the queries share: how the driver's tables stand for records, findings and decisions, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import decisions as D
from curatrix.operators.items import measured
from curatrix.operators.rules import all_findings
from curatrix.operators.triage import buckets, per_item
from curatrix.sources.shared import materialize, table

V1, V2 = (2, 75), (5, 200)
#: What each kind of event decides.
DECIDES = {"view": "UNDECIDED", "click": "KEEP", "signup": "ACCEPTED_STYLE_FALSE_POSITIVE", "purchase": "IMPROVEMENT_CANDIDATE", "error": "REMOVAL_CANDIDATE"}

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: What the running query has written already, by name and folder.
_written: dict[tuple[str, str], DataFrame] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with SQL for the same rows."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _written.clear()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Measured documents with their texts, from a scan of its own."""
    return measured(table(spark, d, "documents"))


def once(name: str, d: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written on its first use in a query and read by all later ones."""
    if (name, d) not in _written:
        _written[name, d] = materialize(make(), name)
    return _written[name, d]


def items(spark: SparkSession, d: str) -> DataFrame:
    """What is measured on documents, without their texts: one scan of them for a query, however often it uses this."""
    return once("items", d, lambda: texts(spark, d).drop("text"))


def findings(spark: SparkSession, d: str, version: tuple[int, int] = V1) -> DataFrame:
    return all_findings(items(spark, d), *version)


def triaged(spark: SparkSession, d: str, version: tuple[int, int] = V1) -> DataFrame:
    return buckets(per_item(items(spark, d), findings(spark, d, version)))


def decision_log(spark: SparkSession, d: str) -> DataFrame:
    return decided_by(table(spark, d, "events"))


def decided_by(events: DataFrame) -> DataFrame:
    """What events decide, of a table or a stream of them."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    decides = F.try_element_at(F.create_map(*(F.lit(x) for kv in DECIDES.items() for x in kv)), F.col("event_type"))
    return e.select(F.col("user_id").alias("item_id"), F.when(F.col("k") >= 30, "caption.long").alias("category"), F.when(F.col("k") >= 60, "caption/v1").alias("analyzer"), decides.alias("decision"), "ts", "event_id")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return D.latest(decision_log(spark, d))


_S = "[ \\t\\n\\x0B\\f\\r]"
M = f"""m AS (
  SELECT doc_id AS item_id, source AS grp, t AS text, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(t, '[A-Za-z0-9_'']+')) AS BIGINT) AS n_tokens, sha256(t) AS sha
  FROM (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '^{_S}+|{_S}+$', '', 'g') AS t FROM documents))"""


def _f(name: str, short: int, long: int) -> str:
    row = lambda category, confidence, where: f"SELECT item_id, 'caption/v1' AS analyzer, '{category}' AS category, 'LOW' AS severity, CAST({confidence} AS DOUBLE) AS confidence FROM c WHERE {where}"
    return f"""{name} AS (
  {row("caption.empty", 0.52, "n_chars = 0")} UNION ALL {row("caption.duplicate", 0.52, "n_chars > 0 AND copies >= 2")}
  UNION ALL {row("caption.short", 0.42, f"n_chars > 0 AND n_tokens <= {short}")} UNION ALL {row("caption.long", 0.40, f"n_chars > 0 AND n_tokens >= {long}")}
  UNION ALL SELECT item_id, 'length/v1', 'length.high', CASE WHEN z >= 3 THEN 'CRITICAL' WHEN z >= 2 THEN 'HIGH' ELSE 'MEDIUM' END, round_even(least(1 / (1 + exp(-0.8 * (z - 1.5))), 0.70), 4) FROM z WHERE n_tokens >= 15 AND z >= 1)"""


Z = "c AS (SELECT *, count(*) OVER (PARTITION BY sha) AS copies FROM m), z AS (SELECT *, CASE WHEN stddev_pop(n_tokens) OVER () > 0 THEN (n_tokens - avg(n_tokens) OVER ()) / stddev_pop(n_tokens) OVER () END AS z FROM m)"
F1, F2 = _f("f", *V1), _f("f2", *V2)
RANK = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"
SEVERITY = "['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"


def _p(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN n_findings = 0 THEN 'READY_FOR_TRAINING' WHEN error OR rank >= 3 OR n_categories >= 2 THEN 'PRIORITY_REVIEW' ELSE 'NEEDS_REVIEW' END AS bucket,
    CASE WHEN n_findings = 0 THEN 'no_findings' WHEN error THEN 'analyzer_error' WHEN rank >= 3 THEN 'finding.high_severity' WHEN n_categories >= 2 THEN 'finding.multiple_categories' ELSE 'finding.present' END AS reason,
    {SEVERITY}[rank + 1] AS strongest
  FROM (SELECT m.item_id, count(category) AS n_findings, count(DISTINCT category) AS n_categories, coalesce(max({RANK}), 0) AS rank, coalesce(max(confidence), 0) AS confidence, coalesce(bool_or(category LIKE '%.error'), false) AS error
    FROM m LEFT JOIN {source} USING (item_id) GROUP BY m.item_id))"""


T1, T2 = _p("t", "f"), _p("t2", "f2")
L = f"""l AS (
  SELECT user_id AS item_id, CASE WHEN k >= 30 THEN 'caption.long' END AS category, CASE WHEN k >= 60 THEN 'caption/v1' END AS analyzer,
    CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DECIDES.items())} END AS decision, ts, event_id
  FROM (SELECT *, CAST(props ->> '$.k' AS INT) AS k FROM events)),
  d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY item_id, category, analyzer ORDER BY ts DESC, event_id DESC) = 1)"""
FIND = f"WITH {M}, {Z}, {F1}"
