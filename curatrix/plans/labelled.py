"""Findings held against labels: toxic items should be long outliers, low-quality ones long (rules are judged, not believed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.semantics import tokens
from curatrix.operators import baseline, calibrate
from curatrix.operators.rules import FLOOR
from curatrix.plans.base import FIND, M, Z, findings, items, query
from curatrix.sources.shared import table

CATEGORIES = ("length.high", "caption.long", "caption.duplicate")
THRESHOLDS = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]


def marked(spark, d):
    l = table(spark, d, "labels").filter("toxic IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("item_id"), F.array_compact(F.array(F.when(F.col("toxic") == 1, "length.high"), F.when(F.col("quality") == 0, "caption.long"), F.when(F.col("toxic") + F.col("quality") == 0, "caption.duplicate"))).alias("categories"))
    return calibrate.against_labels(l, findings(spark, d), CATEGORIES)


_K = f"""{FIND}, k AS (SELECT doc_id AS item_id, category, CASE category WHEN 'length.high' THEN toxic = 1 WHEN 'caption.long' THEN quality = 0 ELSE toxic + quality = 0 END AS actual,
  EXISTS (SELECT 1 FROM f WHERE f.item_id = doc_id AND f.category = c.category) AS predicted FROM labels, (SELECT unnest({list(CATEGORIES)}) AS category) c WHERE toxic IS NOT NULL AND quality IS NOT NULL)"""
_COUNTS = "count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn, count(*) FILTER (NOT actual AND NOT predicted) AS tn"


def _ratios(digits: int, empty: str) -> str:
    one = lambda a, b: f"CASE WHEN {b} <> 0 THEN round({a} / ({b}), {digits}) ELSE {empty} END"
    return f"{one('tp', '(tp + fp)')} AS precision, {one('tp', '(tp + fn)')} AS recall, {one('2 * tp', '(2 * tp + fp + fn)')} AS f1"


_FPR = "CASE WHEN fp + tn <> 0 THEN round(fp / (fp + tn), 6) ELSE 0 END AS fpr"


@query(f"{_K} SELECT *, {_ratios(6, '0')}, {_FPR} FROM (SELECT category, {_COUNTS} FROM k GROUP BY category)")
def label_confusion(spark, d):
    return calibrate.confusion(marked(spark, d), "category")


@query(f"{_K}, a AS (SELECT split_part(category, '.', 1) AS analyzer, item_id, bool_or(actual) AS actual, bool_or(predicted) AS predicted FROM k GROUP BY ALL) SELECT *, {_ratios(6, '0')}, {_FPR} FROM (SELECT analyzer, {_COUNTS} FROM a GROUP BY analyzer)")
def analyzer_confusion(spark, d):
    return calibrate.per_analyzer(marked(spark, d), F.split("category", "\\.")[0])


@query(f"""{_K}, s AS (SELECT *, {_ratios(6, '0')}, {_FPR} FROM (SELECT category, {_COUNTS} FROM k GROUP BY category))
SELECT category, CASE WHEN tp + fp + fn + tn < 10 OR tp + fn < 3 OR fp + tn < 3 THEN 'insufficient_evidence' WHEN fp > 0 AND (precision < 0.95 OR fpr > 0.05) THEN 'false_positive_risk' WHEN fn > 0 AND recall < 0.90 THEN 'false_negative_risk' ELSE 'ready' END AS status FROM s""")
def readiness_gate(spark, d):
    return calibrate.readiness(calibrate.confusion(marked(spark, d), "category")).select("category", "status")


_ZT = f"WITH {M}, {Z}, y AS (SELECT z.*, toxic = 1 AS actual, toxic, quality FROM z JOIN labels ON doc_id = item_id WHERE toxic IS NOT NULL)"


def scored(spark, d):
    have = items(spark, d).select("item_id", "n_tokens", "n_chars")
    z = baseline.against(have, baseline.statistics(have, "n_tokens")).withColumn("z", baseline.z_score("n_tokens"))
    l = table(spark, d, "labels").filter("toxic IS NOT NULL").select(F.col("doc_id").alias("item_id"), "toxic", "quality")
    return z.join(l, "item_id").withColumn("actual", F.col("toxic") == 1)


@query(f"""{_ZT} SELECT *, {_ratios(4, 'NULL')} FROM (SELECT threshold, {_COUNTS} FROM (SELECT threshold, actual, coalesce(z >= threshold, false) AND n_tokens >= 15 AS predicted FROM y, (SELECT CAST(unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS DOUBLE) AS threshold)) GROUP BY threshold)""")
def threshold_sweep(spark, d):
    return calibrate.threshold_sweep(scored(spark, d), "z", "actual", THRESHOLDS, F.col("n_tokens") >= FLOOR)


@query(f"""{_ZT}, s AS (SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1, avg(n_tokens) FILTER (toxic = 0) AS m0, avg(n_tokens) FILTER (toxic = 1) AS m1, var_samp(n_tokens) FILTER (toxic = 0) AS vs0, var_samp(n_tokens) FILTER (toxic = 1) AS vs1,
  var_pop(n_tokens) FILTER (toxic = 0) AS vp0, var_pop(n_tokens) FILTER (toxic = 1) AS vp1 FROM y) SELECT n0, n1, round((m1 - m0) / sqrt(((n1 - 1) * vs1 + (n0 - 1) * vs0) / (n0 + n1 - 2)), 6) AS d_pooled, round((m1 - m0) / sqrt((vp1 + vp0) / 2), 3) AS d_mean FROM s""")
def effect_size(spark, d):
    return calibrate.effect_size(scored(spark, d), "n_tokens", "toxic")


@query(f"{_ZT} SELECT round(corr(n_tokens, toxic), 6) AS tokens_toxic, round(corr(n_tokens, quality), 6) AS tokens_quality, round(corr(n_tokens, n_chars), 6) AS tokens_chars FROM y")
def feature_correlation(spark, d):
    s = scored(spark, d)
    pair = lambda a, b, n: F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(n)
    return s.agg(pair("n_tokens", "toxic", "tokens_toxic"), pair("n_tokens", "quality", "tokens_quality"), pair("n_tokens", "n_chars", "tokens_chars"))


@query(f"""{_ZT} SELECT CASE WHEN z >= 1 THEN 'FINDING' ELSE 'CLEAN' END AS side, count(*) FILTER (quality = 1 AND (z >= 1) = actual) AS agree, count(*) FILTER (quality = 1 AND (z >= 1) <> actual) AS disagree, count(*) FILTER (quality = 0) AS unsure FROM y GROUP BY 1""")
def agreement_buckets(spark, d):
    verdict = F.when(F.col("quality") == 0, "UNSURE").when((F.col("z") >= 1) == F.col("actual"), "AGREE").otherwise("DISAGREE")
    return calibrate.agreement(scored(spark, d).withColumn("verdict", verdict).withColumn("finding", F.col("z") >= 1), "finding", "verdict")


@query(f"{_K} SELECT item_id, category FROM k WHERE predicted AND NOT actual")
def fp_examples(spark, d):
    return calibrate.examples(marked(spark, d), "fp")


@query(f"{_K} SELECT item_id, category FROM k WHERE actual AND NOT predicted")
def fn_examples(spark, d):
    return calibrate.examples(marked(spark, d), "fn")


_BT = "len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_'']+'))"


@query(f"""WITH b AS (SELECT item_id AS id, text, {_BT} AS n FROM benchmark), d AS (SELECT DISTINCT text FROM documents), e AS (SELECT id, n >= 20 AS should_detect, CASE WHEN n >= 30 THEN 'MEDIUM' END AS expected_severity, CASE WHEN n >= 25 THEN 'MEDIUM' WHEN n >= 15 THEN 'LOW' END AS severity FROM b)
SELECT id, severity, CASE WHEN should_detect IS NULL THEN 'SKIP' WHEN should_detect <> (severity IS NOT NULL) THEN 'FAIL' WHEN severity IS NOT NULL AND expected_severity IS NOT NULL AND expected_severity <> severity THEN 'FAIL' ELSE 'PASS' END AS result FROM e""")
def expectation_check(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.size(tokens(F.coalesce("text", F.lit("")))).alias("n"))
    expected = b.select("id", (F.col("n") >= 20).alias("should_detect"), F.when(F.col("n") >= 30, "MEDIUM").alias("expected_severity"))
    observed = b.filter("n >= 15").select("id", F.when(F.col("n") >= 25, "MEDIUM").otherwise("LOW").alias("severity"))
    return calibrate.containment(expected, observed).select("id", "severity", "result")
