"""Preview artifacts in two commits: pages as candidates for documents, some of them replaced by the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.plans.base import query
from curatrix.sources import artifacts
from curatrix.sources.shared import new_path, table


def _candidates(df, filename, kind, provider):
    return df.select(F.concat(F.lit("preview-"), F.col("n").cast("string")).alias("preview_id"), F.col("t").cast("binary").alias("content"), filename.alias("filename"), kind.alias("format"), F.lit(provider).alias("provider"))


def _imported(spark, d):
    """The store's folder and the outcomes of both commits."""
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages").selectExpr("page_id AS n", "html AS t")
    previews = docs.select(F.concat(F.lit("preview-"), F.col("doc_id").cast("string")).alias("preview_id"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"))
    name = lambda prefix: F.concat(F.lit(prefix), F.col("n").cast("string"))
    png = F.when(F.col("n") % 7 == 0, "GIF").otherwise("PNG")
    first = _candidates(pages, name("page-"), png, "manual").union(_candidates(docs.filter("doc_id % 5 = 0").selectExpr("doc_id AS n", "text AS t"), name("document-"), F.lit("JPEG"), "manual"))
    second = _candidates(pages.filter("n % 3 < 2").selectExpr("n", "CASE WHEN n % 3 = 0 THEN concat(t, '!') ELSE t END AS t"), name("again-"), F.lit("WEBP"), "generated")
    folder, outcomes = new_path(spark, "artifacts"), []
    for rows, replace in ((first, False), (second, True)):
        batch = artifacts.Import(spark, folder)
        told = batch.prepare(rows, previews, replace)
        version = batch.commit()
        outcomes.append(told.withColumn("version", F.lit(version).cast("long")))
    return folder, outcomes[0].union(outcomes[1])


_O = """d AS (SELECT 'preview-' || doc_id AS p, count(*) AS plans, min(sha256(text)) AS source FROM documents GROUP BY ALL),
c1 AS (SELECT 'preview-' || page_id AS p, sha256(html) AS s, octet_length(encode(html)) AS n, 'page-' || page_id AS f, CASE WHEN page_id % 7 = 0 THEN 'GIF' ELSE 'PNG' END AS k FROM pages UNION ALL SELECT 'preview-' || doc_id, sha256(text), octet_length(encode(text)), 'document-' || doc_id, 'JPEG' FROM documents WHERE doc_id % 5 = 0),
c2 AS (SELECT 'preview-' || page_id AS p, sha256(CASE WHEN page_id % 3 = 0 THEN html || '!' ELSE html END) AS s, octet_length(encode(CASE WHEN page_id % 3 = 0 THEN html || '!' ELSE html END)) AS n, 'again-' || page_id AS f, 'WEBP' AS k FROM pages WHERE page_id % 3 < 2),
j1 AS (SELECT c1.*, CASE WHEN plans IS NULL THEN 'no preview' WHEN plans > 1 THEN 'ambiguous preview' WHEN s IS NULL THEN 'no content' WHEN k = 'GIF' THEN 'unknown format' WHEN s = source THEN 'same as source' WHEN min(s) OVER (PARTITION BY c1.p) <> max(s) OVER (PARTITION BY c1.p) THEN 'ambiguous candidate' ELSE 'imported' END AS o FROM c1 LEFT JOIN d USING (p)),
i1 AS (SELECT p, s, n, f, k FROM j1 WHERE o = 'imported' QUALIFY row_number() OVER (PARTITION BY p ORDER BY f) = 1),
j2 AS (SELECT c2.*, CASE WHEN plans IS NULL THEN 'no preview' WHEN plans > 1 THEN 'ambiguous preview' WHEN c2.s IS NULL THEN 'no content' WHEN c2.s = source THEN 'same as source' WHEN min(c2.s) OVER (PARTITION BY c2.p) <> max(c2.s) OVER (PARTITION BY c2.p) THEN 'ambiguous candidate' WHEN c2.s = i1.s THEN 'unchanged' ELSE 'imported' END AS o FROM c2 LEFT JOIN d USING (p) LEFT JOIN i1 ON i1.p = c2.p),
i2 AS (SELECT p, s, n, f, k FROM j2 WHERE o = 'imported' QUALIFY row_number() OVER (PARTITION BY p ORDER BY f) = 1)"""
_A = "'artifact-' || substr(sha256(p || ':' || s), 1, 24) AS artifact_id"


@query(f"WITH {_O} SELECT p AS preview_id, {_A}, f AS filename, o AS outcome, CAST(v AS BIGINT) AS version FROM (SELECT p, s, f, o, 1 AS v FROM j1 UNION ALL SELECT p, s, f, o, 2 FROM j2)")
def artifact_outcomes(spark, d):
    """What became of each candidate."""
    return _imported(spark, d)[1]


@query(f"""WITH {_O}, a AS (SELECT *, 1 AS v FROM i1 WHERE p NOT IN (SELECT p FROM i2) UNION ALL SELECT *, 2 FROM i2)
SELECT p AS preview_id, {_A}, s AS sha256, 'artifacts/' || p || '/candidate-' || substr(s, 1, 16) || CASE k WHEN 'PNG' THEN '.png' WHEN 'JPEG' THEN '.jpg' ELSE '.webp' END AS reference, f AS filename, CAST(n AS BIGINT) AS n_bytes, CAST(v AS BIGINT) AS version, true AS sound FROM a""")
def artifact_records(spark, d):
    """The artifact of each preview after both commits, and whether its bytes are found by its id."""
    folder, _ = _imported(spark, d)
    have = artifacts.records(spark, folder)
    found = artifacts.resolved(spark, folder, have).withColumn("sound", F.col("content").isNotNull())
    return have.join(found, "artifact_id").select("preview_id", "artifact_id", "sha256", "reference", "filename", "n_bytes", "version", "sound")
