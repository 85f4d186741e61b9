"""Two runs over the same documents, with the rules of V1 and of V2, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import compare
from curatrix.plans.base import F1, F2, M, T1, T2, V2, Z, findings, query, triaged
from curatrix.sources.shared import table

_B = f"WITH {M}, {Z}, {F1}, {F2}"
_KEY = "item_id, category, analyzer, severity"


def runs(spark, d):
    return findings(spark, d), findings(spark, d, V2)


@query(f"{_B} SELECT {_KEY} FROM f2 EXCEPT ALL SELECT {_KEY} FROM f")
def new_findings(spark, d):
    return compare.new_findings(*runs(spark, d))


@query(f"{_B} SELECT {_KEY} FROM f EXCEPT ALL SELECT {_KEY} FROM f2")
def resolved_findings(spark, d):
    return compare.resolved_findings(*runs(spark, d))


@query(f"{_B} SELECT count(*) AS n FROM (SELECT {_KEY} FROM f INTERSECT ALL SELECT {_KEY} FROM f2)")
def unchanged_count(spark, d):
    return compare.unchanged(*runs(spark, d))


@query(f"{_B}, {T1}, {T2} SELECT item_id, t.bucket AS before, t2.bucket AS after FROM t JOIN t2 USING (item_id) WHERE t.bucket <> t2.bucket")
def changed_buckets(spark, d):
    return compare.changed(triaged(spark, d), triaged(spark, d, V2), "item_id", "bucket")


@query(f"{_B} SELECT DISTINCT item_id FROM f WHERE item_id NOT IN (SELECT item_id FROM f2)")
def only_in_before(spark, d):
    return compare.only_in(*runs(spark, d), "item_id")


@query(f"{_B} SELECT DISTINCT item_id FROM f2 WHERE item_id NOT IN (SELECT item_id FROM f)")
def only_in_after(spark, d):
    return compare.only_in(*reversed(runs(spark, d)), "item_id")


@query(f"{_B} SELECT category, count(*) FILTER (r = 1) AS before, count(*) FILTER (r = 2) AS after, count(*) FILTER (r = 2) - count(*) FILTER (r = 1) AS delta FROM (SELECT category, 1 AS r FROM f UNION ALL SELECT category, 2 FROM f2) GROUP BY category")
def count_deltas(spark, d):
    return compare.count_deltas(*runs(spark, d), "category")


@query("""WITH b AS (SELECT n_name AS name, CASE WHEN n_regionkey < 3 THEN 'v1' END AS v0, 'show' AS p0 FROM nation WHERE n_regionkey < 3), a AS (SELECT n_name AS name, CASE n_regionkey WHEN 1 THEN 'v2' ELSE 'v1' END AS v1, CASE n_regionkey WHEN 2 THEN 'hide' ELSE 'show' END AS p1 FROM nation WHERE n_regionkey > 0),
j AS (SELECT * FROM b FULL JOIN a USING (name)) SELECT name, 'removed' AS kind, v0 AS before, v1 AS after FROM j WHERE v1 IS NULL UNION ALL SELECT name, 'added', v0, v1 FROM j WHERE v0 IS NULL UNION ALL SELECT name, 'version', v0, v1 FROM j WHERE v0 <> v1 UNION ALL SELECT name, 'policy', p0, p1 FROM j WHERE p0 <> p1""")
def provenance_diff(spark, d):
    """Manifests of two runs: nations stand for analyzers, and regions for what changed."""
    n = table(spark, d, "nation").withColumnRenamed("n_name", "name")
    r = F.col("n_regionkey")
    before = n.filter(r < 3).select("name", F.lit("v1").alias("version"), F.lit("show").alias("policy"))
    after = n.filter(r > 0).select("name", F.when(r == 1, "v2").otherwise("v1").alias("version"), F.when(r == 2, "hide").otherwise("show").alias("policy"))
    return compare.provenance(before, after)
