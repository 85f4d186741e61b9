"""Baselines, rules, triage and roll-ups over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.semantics import base_name, score, suffix
from curatrix.operators import baseline, duplicates, rollup, rules, triage
from curatrix.operators.numbering import numbered
from curatrix.plans.base import FIND, M, SEVERITY, T1, RANK, L, Z, decisions, findings, items, query, texts, triaged
from curatrix.operators.decisions import image_level
from curatrix.sources.shared import table
from curatrix.streaming import events as streams

TERMS = ["the", "de la", "und"]


@query(f"WITH {M} SELECT item_id, n_chars, n_tokens, sha FROM m")
def text_measures(spark, d):
    return texts(spark, d).select("item_id", "n_chars", "n_tokens", "sha")


@query(f"{FIND} SELECT item_id, category, severity, confidence FROM f WHERE analyzer = 'caption/v1'")
def caption_rules(spark, d):
    return rules.caption_findings(items(spark, d)).select("item_id", "category", "severity", "confidence")


@query(f"WITH {M} SELECT m.item_id, g.first, g.n FROM m JOIN (SELECT sha, min(item_id) AS first, count(*) AS n FROM m WHERE n_chars > 0 GROUP BY sha HAVING count(*) >= 2) g USING (sha)")
def caption_exact_duplicates(spark, d):
    have = items(spark, d).filter("n_chars > 0")
    return have.select("item_id", "sha").join(duplicates.exact_groups(have), "sha").select("item_id", "first", "n")


_TOK = "' ' || lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9_'']+'), ' ')) || ' '"
_TERM = " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (contains(tok, ' {t} ')) AS n, count(*) AS total FROM k" for t in TERMS)


@query(f"WITH {M}, k AS (SELECT {_TOK} AS tok FROM m WHERE n_chars > 0) SELECT term, n, total, round(100 * n / total, 1) AS pct FROM ({_TERM})")
def caption_term_shares(spark, d):
    return rules.term_shares(texts(spark, d), TERMS)


@query(f"WITH {M}, k AS (SELECT item_id, {_TOK} AS tok FROM m WHERE n_chars > 0), s AS ({_TERM}) SELECT item_id, term FROM k, s WHERE n >= 0.5 * total AND total >= 5 AND contains(tok, ' ' || term || ' ')")
def caption_token_imbalance(spark, d):
    return rules.token_imbalance(texts(spark, d), TERMS, share=0.5).select("item_id", "term")


_STATS = "count(*) AS n, round(avg(n_tokens), 6) AS mean, round(stddev_pop(n_tokens), 6) AS stddev, min(n_tokens) AS least, max(n_tokens) AS most"


@query(f"WITH {M} SELECT {_STATS}, list_sort(list(n_tokens))[CAST(floor(count(*) * 0.1) AS INT) + 1] AS p10, list_sort(list(n_tokens))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90 FROM m")
def baseline_global(spark, d):
    have = items(spark, d).select("n_tokens")
    stats = baseline.statistics(have, "n_tokens").withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})
    return stats.crossJoin(baseline.index_percentiles(have, "n_tokens", {"p10": 0.1, "p90": 0.9}))


@query(f"WITH {M} SELECT grp, {_STATS}, list_sort(list(n_tokens))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90 FROM m GROUP BY grp")
def baseline_by_source(spark, d):
    have = items(spark, d).select("grp", "n_tokens")
    stats = baseline.statistics(have, "n_tokens", "grp").withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})
    return stats.join(baseline.index_percentiles(have, "n_tokens", {"p90": 0.9}, "grp"), "grp")


_ZF = "CASE WHEN z >= 3 THEN 'CRITICAL' WHEN z >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round_even(least(1 / (1 + exp(-0.8 * (z - 1.5))), 0.70), 4) AS confidence, round(z, 6) AS z"


@query(f"WITH {M}, {Z} SELECT item_id, {_ZF} FROM z WHERE z >= 1 AND n_tokens >= 15")
def length_zscore_findings(spark, d):
    return rules.z_findings(items(spark, d), "n_tokens", "length.high").select("item_id", "severity", "confidence", F.round("z", 6).alias("z"))


_ZG = "z AS (SELECT *, CASE WHEN stddev_pop(n_tokens) OVER (PARTITION BY grp) > 0 THEN (n_tokens - avg(n_tokens) OVER (PARTITION BY grp)) / stddev_pop(n_tokens) OVER (PARTITION BY grp) END AS z FROM m)"


@query(f"WITH {M}, {_ZG} SELECT item_id, {_ZF} FROM z WHERE z >= 1 AND n_tokens >= 15")
def length_zscore_by_source(spark, d):
    have = items(spark, d)
    held = baseline.against(have, baseline.statistics(have, "n_tokens", "grp"), "grp").withColumn("z", baseline.z_score("n_tokens")).filter("z >= 1 AND n_tokens >= 15")
    return held.select("item_id", rules.z_severity(F.col("z")).alias("severity"), rules.z_confidence(F.col("z")).alias("confidence"), F.round("z", 6).alias("z"))


@query(f"{FIND}, {T1} SELECT item_id, n_findings, n_categories, strongest, bucket, reason FROM t")
def triage_buckets(spark, d):
    return triaged(spark, d).select("item_id", "n_findings", "n_categories", "strongest", "bucket", "reason")


@query(f"""{FIND}, {T1} SELECT item_id, CASE WHEN n_findings = 0 THEN 'no_attention_needed' WHEN error OR n_categories > 1 THEN 'priority_review' ELSE 'review_recommended' END AS outcome,
  CASE WHEN n_findings = 0 THEN 'none' WHEN error OR n_categories > 1 THEN 'high' WHEN rank >= 2 THEN 'medium' ELSE 'low' END AS priority FROM t""")
def review_queue_outcomes(spark, d):
    per = triage.per_item(items(spark, d), findings(spark, d))
    return triage.queue_outcomes(per).select("item_id", "outcome", "priority")


@query(f"{FIND} SELECT category, severity, count(f.item_id) AS n FROM (SELECT DISTINCT category FROM f) c CROSS JOIN (SELECT unnest({SEVERITY}) AS severity) s LEFT JOIN f USING (category, severity) GROUP BY category, severity")
def findings_by_category_severity(spark, d):
    return rollup.by_category_severity(findings(spark, d))


@query(f"{FIND} SELECT category, severity, analyzer, count(*) AS n, CAST(grouping(category, severity, analyzer) AS BIGINT) AS level FROM f GROUP BY GROUPING SETS ((category), (severity), (analyzer), ())")
def findings_grouping_sets(spark, d):
    return rollup.one_pass(findings(spark, d))


@query(f"{FIND} SELECT name, count(item_id) AS n, count(DISTINCT item_id) AS items, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories FROM (SELECT unnest(['caption', 'length', 'texture']) AS name) a LEFT JOIN f ON split_part(analyzer, '/', 1) = name GROUP BY name")
def analyzer_coverage(spark, d):
    return rollup.coverage(findings(spark, d), ("caption", "length", "texture"))


@query(f"{FIND} SELECT category, count(*) AS n, {SEVERITY}[max({RANK}) + 1] AS strongest FROM f GROUP BY category ORDER BY n DESC, category LIMIT 8")
def top_categories(spark, d):
    return rollup.top_categories(findings(spark, d))


@query(f"""{FIND}, {L}, g AS (SELECT DISTINCT item_id FROM d WHERE category IS NULL AND decision <> 'UNDECIDED')
SELECT category, count(*) AS findings, count(DISTINCT item_id) AS items, count(DISTINCT item_id) FILTER (item_id NOT IN (SELECT item_id FROM g)) AS undecided, round(100 * count(DISTINCT item_id) / (SELECT count(*) FROM m), 1) AS pct FROM f GROUP BY category""")
def evidence_summary(spark, d):
    decided = image_level(decisions(spark, d)).filter("decision <> 'UNDECIDED'")
    return rollup.evidence_summary(findings(spark, d), items(spark, d), decided)


@query(f"""{FIND}, p AS (SELECT m.item_id, min(category) AS a, max(category) AS b, coalesce(bool_or(category LIKE '%.error'), false) AS e FROM m LEFT JOIN f USING (item_id) GROUP BY m.item_id)
SELECT CASE WHEN a IS NULL THEN 'none' WHEN e THEN 'errors' WHEN a <> b THEN 'multiple' ELSE a END AS family, count(*) AS n FROM p GROUP BY 1""")
def finding_families(spark, d):
    return rollup.families(findings(spark, d), items(spark, d))


@query(f"WITH {M} SELECT item_id, n_tokens FROM m ORDER BY n_tokens DESC, item_id LIMIT 5")
def top_items(spark, d):
    return texts(spark, d).select("item_id", "n_tokens").orderBy(F.desc("n_tokens"), "item_id").limit(5)


@query(f"WITH {M} SELECT item_id, row_number() OVER (ORDER BY n_tokens DESC, item_id) AS place, round_even(greatest(0, least(100, 100 * (1 - exp(-n_tokens / 900)))), 2) AS score FROM m")
def score_table(spark, d):
    return numbered(items(spark, d).select("item_id", "n_tokens"), F.desc("n_tokens"), F.col("item_id").asc(), name="place").select("item_id", "place", score("n_tokens", 900).alias("score"))


@query(f"{FIND}, {T1} SELECT item_id, row_number() OVER (ORDER BY rank DESC, n_findings DESC, confidence DESC, item_id) AS place FROM t")
def review_order(spark, d):
    per = triaged(spark, d).withColumn("decided", F.lit(False)).select("item_id", "rank", "n_findings", "confidence", "decided")
    return numbered(per, *triage.urgency(per), name="place").select("item_id", "place")


@query(f"{FIND}, {T1} SELECT item_id, row_number() OVER (ORDER BY CASE bucket WHEN 'PRIORITY_REVIEW' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, error DESC, rank DESC, item_id) AS place FROM (SELECT item_id, rank, bucket, error FROM t WHERE item_id % 11 <> 0 UNION ALL SELECT item_id, rank, 'PRIORITY_REVIEW', true FROM t WHERE item_id % 11 = 0)")
def triage_listing(spark, d):
    """The triaged dataset in its order; every eleventh item's analysis counts as failed."""
    failed = F.col("item_id") % 11 == 0
    t = triaged(spark, d).select("item_id", "rank", F.when(failed, "PRIORITY_REVIEW").otherwise(F.col("bucket")).alias("bucket"), (failed | F.col("error")).alias("error"))
    return numbered(t, *triage.triage_order(), name="place").select("item_id", "place")


_FAILED = "SELECT item_id, category FROM f UNION ALL SELECT item_id, 'caption.error' FROM m WHERE item_id % 17 = 0"


@query(f"""{FIND}, h AS ({_FAILED}) SELECT (SELECT count(*) FROM m) AS items, count(DISTINCT item_id) AS with_findings, (SELECT count(*) FROM m) - count(DISTINCT item_id) AS without_findings, count(*) FILTER (category LIKE '%.error') AS errors,
  (SELECT string_agg(category, ',' ORDER BY n DESC, category) FROM (SELECT category, count(*) AS n FROM h WHERE category NOT LIKE '%.error' GROUP BY category)) AS dominant FROM h""")
def dataset_summary(spark, d):
    failed = items(spark, d).filter("item_id % 17 = 0").select("item_id", F.lit("caption.error").alias("category"))
    return rollup.dataset_summary(findings(spark, d).select("item_id", "category").unionByName(failed), items(spark, d))


@query("""WITH c AS (SELECT n_name AS analyzer, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'v1' END AS version, n_nationkey AS finding_count, n_nationkey % 5 AS image_count, CASE WHEN n_nationkey % 3 = 0 THEN 'calibrated' END AS calibration FROM nation WHERE n_regionkey > 0),
m AS (SELECT n_name AS analyzer, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'v2' END AS version, 'family ' || n_regionkey AS family, CASE WHEN n_nationkey % 3 <> 1 THEN n_nationkey + 100 END AS finding_count, n_nationkey + 50 AS image_count, CASE WHEN n_nationkey % 5 = 0 THEN 'provisional' END AS calibration FROM nation WHERE n_regionkey < 3)
SELECT analyzer, coalesce(nullif(m.version, ''), nullif(c.version, ''), '') AS version, coalesce(family, 'not recorded') AS family, coalesce(m.finding_count, c.finding_count, 0) AS finding_count, coalesce(m.image_count, c.image_count, 0) AS image_count, coalesce(m.calibration, c.calibration, 'advisory fallback') AS calibration,
  CASE WHEN m.family IS NOT NULL THEN 'inspection_manifest' ELSE 'recommendation_summary' END AS source FROM c FULL JOIN m USING (analyzer)""")
def analyzer_contribution(spark, d):
    """Nations stand for analyzers, of which the coverage and the manifest name some each."""
    n, k = table(spark, d, "nation").withColumnRenamed("n_name", "analyzer"), F.col("n_nationkey")
    covered = n.filter("n_regionkey > 0").select("analyzer", F.when(k % 4 == 0, "").otherwise("v1").alias("version"), k.alias("finding_count"), (k % 5).alias("image_count"), F.when(k % 3 == 0, "calibrated").alias("calibration"))
    manifest = n.filter("n_regionkey < 3").select("analyzer", F.when(k % 2 == 0, "").otherwise("v2").alias("version"), F.concat(F.lit("family "), "n_regionkey").alias("family"), F.when(k % 3 != 1, k + 100).alias("finding_count"), (k + 50).alias("image_count"), F.when(k % 5 == 0, "provisional").alias("calibration"))
    return rollup.contribution(covered, manifest)


@query(f"""{FIND}, {T1} SELECT bucket, item_id FROM t QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY confidence DESC, item_id) <= 5""")
def gallery_groups(spark, d):
    """The five items of each bucket that stand out: partial top-k on each task, then of all."""
    t = triaged(spark, d).select("bucket", "item_id", "confidence")
    out = None
    for b in ("PRIORITY_REVIEW", "NEEDS_REVIEW", "READY_FOR_TRAINING"):
        one = t.filter(F.col("bucket") == b).orderBy(F.desc("confidence"), "item_id").limit(5)
        out = one if out is None else out.unionByName(one)
    return out.select("bucket", "item_id")


@query(f"WITH {M} SELECT first AS item_id, n, printf('duplicate-group-%04d', row_number() OVER (ORDER BY first)) AS group_id FROM (SELECT min(item_id) AS first, count(*) AS n FROM m WHERE n_chars > 0 GROUP BY sha HAVING count(*) >= 2)")
def duplicate_groups(spark, d):
    groups = duplicates.exact_groups(items(spark, d).filter("n_chars > 0"))
    return duplicates.numbered_groups(groups).select(F.col("first").alias("item_id"), "n", "group_id")


@query(f"""WITH {M} SELECT item_id, first(item_id) OVER w AS representative, count(*) OVER (PARTITION BY sha) AS n, CASE WHEN item_id = first(item_id) OVER w THEN 'representative' ELSE 'candidate' END AS role
FROM m WHERE n_chars > 0 WINDOW w AS (PARTITION BY sha ORDER BY grp DESC, item_id) QUALIFY n >= 2""")
def duplicate_representative(spark, d):
    # the text is the same in a group, so what ranks is the source (the last name first) and then the id
    have = items(spark, d).filter("n_chars > 0").withColumn("g", F.col("grp"))
    top = have.groupBy("sha").agg(F.max("grp").alias("top"))
    return duplicates.representatives(have.join(top, "sha"), [F.when(F.col("grp") == F.col("top"), 0).otherwise(1)])


@query(f"WITH {M} SELECT item_id, first AS exact_duplicate_of FROM (SELECT item_id, min(item_id) OVER (PARTITION BY sha) AS first FROM m) WHERE item_id <> first")
def first_occurrence_of(spark, d):
    return duplicates.first_occurrence(items(spark, d))


@query("SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(coalesce(text, '')) HAVING count(*) >= 2)")
def exact_duplicate_count(spark, d):
    from pyspark.sql import functions as F

    texts = table(spark, d, "documents").select(F.lit(0).cast("long").alias("item_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return duplicates.exact_groups(texts).agg(F.sum(F.col("n") - 1).cast("long").alias("n"))


@query("""WITH c AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM conversations), k AS (SELECT *, len(regexp_extract_all(t, '[A-Za-z0-9_'']+')) AS n FROM c),
g AS (SELECT role, t, count(*) AS copies FROM k GROUP BY role, t)
SELECT role, count(*) AS turns, CAST(sum(CASE WHEN n <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN n >= 75 THEN 1 ELSE 0 END) AS BIGINT) AS long, CAST(sum(CASE WHEN copies >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM k JOIN g USING (role, t) GROUP BY role""")
def turn_caption_rules(spark, d):
    from curatrix.functions.semantics import strip, token_count

    turns = table(spark, d, "conversations").select("role", strip("text").alias("t")).select("role", F.sha2("t", 256).alias("sha"), token_count("t").alias("n"))
    copies = turns.groupBy("role", "sha").agg(F.count("*").alias("copies")).filter("copies >= 2")
    marked = turns.join(copies, ["role", "sha"], "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return marked.groupBy("role").agg(F.count("*").alias("turns"), count(F.col("n") <= 2).alias("short"), count(F.col("n") >= 75).alias("long"), count(F.col("copies").isNotNull()).alias("repeated"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://([^/]+).*$', '\\1') AS host, CAST(length(html) AS BIGINT) AS size, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '(\\.[^.]*)$', 1)) AS suffix FROM pages)
SELECT host, suffix, count(*) AS pages, round(avg(size), 6) AS mean_size, CAST(sum(CASE WHEN size < 1000 THEN 1 ELSE 0 END) AS BIGINT) AS small FROM p GROUP BY host, suffix""")
def page_source_context(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    p = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://([^/]+).*$", "$1").alias("host"), F.length("html").cast("long").alias("size"), suffix(base_name(path)).alias("suffix"))
    return p.groupBy("host", "suffix").agg(F.count("*").alias("pages"), F.round(F.avg("size"), 6).alias("mean_size"), F.sum(F.when(F.col("size") < 1000, 1).otherwise(0)).cast("long").alias("small"))


@query("""WITH o AS (SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT segment, avg(v) AS mean, stddev_pop(v) AS sd FROM o GROUP BY segment)
SELECT o_orderkey, segment, nation, round((v - mean) / sd, 6) AS z FROM o JOIN s USING (segment) WHERE (v - mean) / sd >= 1.6""")
def metric_outliers_by_segment(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))  # 25 rows in every scale
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("v"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "segment", "nation", "v")
    held = baseline.against(joined, baseline.statistics(joined, "v", "segment"), "segment").withColumn("z", baseline.z_score("v"))
    return held.filter("z >= 1.6").select("o_orderkey", "segment", "nation", F.round("z", 6).alias("z"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, event_type || ':' || coalesce(props ->> '$.k', '') AS label FROM events")
def json_evidence_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.cast("long").alias("k"), F.concat("event_type", F.lit(":"), F.coalesce(k, F.lit(""))).alias("label"))


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """The batch form of streaming.events.windowed."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.windowed(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def event_sessions(spark, d):
    """The batch form of streaming.events.sessions."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""{FIND}, {L} SELECT f.item_id, string_agg(f.category || ' ' || f.analyzer || ' ' || f.severity, '; ' ORDER BY f.category, f.analyzer, f.severity, f.confidence) AS findings, any_value(w.decision) AS decision FROM f LEFT JOIN (SELECT item_id, decision FROM d WHERE category IS NULL AND analyzer IS NULL) w ON w.item_id = f.item_id GROUP BY f.item_id""")
def item_dossiers(spark, d):
    """What is known of each item with findings, and what was decided on it."""
    found = rollup.dossiers(findings(spark, d), image_level(decisions(spark, d)))
    told = F.transform("findings", lambda x: F.concat_ws(" ", x["category"], x["analyzer"], x["severity"]))
    return found.select("item_id", F.array_join(told, "; ").alias("findings"), "decision")
