"""Quality, health and the ordered policies, over metrics that are derived from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.semantics import ladder, score
from curatrix.operators import duplicates, engine, quality, rules, sketches
from curatrix.plans.base import M, items, once, query
from curatrix.sources.shared import new_path, table


def metrics(spark, d):
    """Metrics of an item's quality, written once: every score is a projection over them or one aggregate."""
    return once("metrics", d, lambda: _metrics(spark, d))


def _metrics(spark, d):
    have = items(spark, d)
    first = duplicates.first_occurrence(have)
    n, c = F.col("n_tokens"), F.col("n_chars")
    rows = have.join(first, "item_id", "left").select(
        "item_id", "grp", F.lit("analyzed").alias("status"), score("n_tokens", 900).alias("artifact"), score("n_chars", 8000).alias("texture"), F.col("exact_duplicate_of").alias("exact_of"), F.lit(None).cast("long").alias("probable_of"),
        (c / 2000).alias("megapixels"), (c / (n + 1) * 10).alias("brightness"), (25 + n % 40).cast("double").alias("contrast"), (0.5 + (c % 100) / 50).alias("aspect_ratio"), "n_tokens", "n_chars",
    )
    return rows


_T5 = "round_even(greatest(0, least(100, 100 * (1 - exp(-{v} / {s})))), 2)"
_X = f"""x AS (SELECT item_id, grp, n_tokens, n_chars, {_T5.format(v="n_tokens", s=900)} AS artifact, {_T5.format(v="n_chars", s=8000)} AS texture, CASE WHEN item_id <> min(item_id) OVER (PARTITION BY sha) THEN min(item_id) OVER (PARTITION BY sha) END AS exact_of,
  n_chars / 2000 AS megapixels, n_chars / (n_tokens + 1) * 10 AS brightness, CAST(25 + n_tokens % 40 AS DOUBLE) AS contrast, 0.5 + (n_chars % 100) / 50 AS aspect_ratio FROM m)"""
_C = lambda e: f"round_even(greatest(0, least(100, {e})), 2)"
_Q = f"""o AS (SELECT median(brightness) AS b0, median(contrast) AS c0 FROM x), y AS (SELECT x.*, {_C("100 - abs(brightness - b0) * 2.5")} AS bc, {_C(f"0.6 * {_C('100 - abs(contrast - c0) * 3')} + 0.4 * (100 - least(abs(contrast - 35) * 2.2, 100))")} AS cs,
  CASE WHEN megapixels <= 0.25 THEN {_C("megapixels / 0.25 * 25")} WHEN megapixels <= 1 THEN {_C("25 + (megapixels - 0.25) / 0.75 * 35")} WHEN megapixels <= 4 THEN {_C("60 + (megapixels - 1) / 3 * 40")} ELSE 100 END AS rs, CASE WHEN exact_of IS NOT NULL THEN 100 ELSE 0 END AS risk FROM x, o)"""


@query(f"WITH {M}, {_X}, {_Q} SELECT item_id, round({_C('0.25 * (100 - artifact) + 0.15 * (100 - texture) + 0.20 * (100 - risk) + 0.15 * rs + 0.10 * bc + 0.15 * cs')}, 1) AS quality, rs AS resolution FROM y")
def quality_score(spark, d):
    return quality.item_quality(metrics(spark, d)).select("item_id", F.round("quality", 1).alias("quality"), "resolution")


def _dist(v: str, s: float) -> str:
    return _C(f"100 - stddev_pop({v}) / {s} * 100")


@query(f"""WITH {M}, {_X}, h AS (SELECT count(*) AS items, {_C("100 * (1 - avg(CASE WHEN exact_of IS NOT NULL THEN 1.0 ELSE 0.0 END))")} AS exact_duplicates, 100.0::DOUBLE AS probable_duplicates, {_C("100 - avg(artifact)")} AS artifact_burden, {_C("100 - avg(texture)")} AS texture_burden,
  {_dist("megapixels", 1.5)} AS resolution_consistency, {_dist("brightness", 18)} AS brightness_consistency, {_dist("contrast", 15)} AS contrast_consistency, {_dist("aspect_ratio", 0.35)} AS aspect_ratio_consistency FROM x)
SELECT *, {_C("0.15 * exact_duplicates + 0.10 * probable_duplicates + 0.20 * artifact_burden + 0.10 * texture_burden + 0.15 * resolution_consistency + 0.10 * brightness_consistency + 0.10 * contrast_consistency + 0.10 * aspect_ratio_consistency")} AS health FROM h""")
def dataset_health(spark, d):
    return quality.dataset_health(metrics(spark, d))


_POLICY = """CASE WHEN exact_of IS NOT NULL THEN 'EXCLUDE' WHEN megapixels > 0 AND megapixels < 0.25 THEN 'REGENERATE' WHEN artifact >= 75 THEN 'CLEAN_STRONG' WHEN artifact >= 60 THEN 'CLEAN_MEDIUM' WHEN artifact >= 45 THEN 'CLEAN_LIGHT'
  WHEN texture >= 75 THEN 'TEXTURE_NORMALIZE_LIGHT' WHEN megapixels > 0 AND megapixels < 1 THEN 'MANUAL_REVIEW' WHEN bc < 60 OR cs < 60 THEN 'MANUAL_REVIEW' ELSE 'KEEP' END"""


def _policy(spark, d):
    return quality.policy(quality.item_quality(metrics(spark, d)), {})


_SURE = "CAST(least(97, round_even(68 + greatest(0, {m}) * {k}, 0)) AS INT)"
_ABOVE = "printf('Artifact score is %.1f, %.0f%% above the dataset average.', round_even(artifact, 1), round_even((artifact - aa) / aa * 100, 0))"
#: Each rule by hand: what must hold, action, level, issue, explanation, confidence, preset and strength.
_RULES = [
    ("exact_of IS NOT NULL", "'EXCLUDE'", "'CRITICAL'", "'Exact duplicate'", "'File content matches ' || exact_of || '.'", "99", "''", "''"),
    ("megapixels > 0 AND megapixels < 0.25", "'REGENERATE'", "'CRITICAL'", "'Very low resolution'", "printf('Image resolution is %.3f MP, below 0.25 MP.', round_even(megapixels, 3))", _SURE.format(m="0.25 - megapixels", k="1.2 * 100"), "''", "''"),
    ("{texture}", "CASE WHEN review THEN 'MANUAL_REVIEW' WHEN medium THEN 'TEXTURE_NORMALIZE_MEDIUM' ELSE 'TEXTURE_NORMALIZE_LIGHT' END", "'WARNING'", "CASE WHEN review THEN 'Texture signals require review' WHEN medium THEN 'Elevated texture burden' ELSE 'Mild texture burden' END",
     "printf('Microtexture is %s the dataset average (%.1f versus %.1f). ', CASE WHEN microtexture > tm + 2 THEN 'above' WHEN microtexture < tm - 2 THEN 'below' ELSE 'near' END, round_even(microtexture, 1), round_even(tm, 1)) || CASE WHEN review THEN 'Texture and edge signals are unusually strong or conflicting.' WHEN medium THEN 'Fine texture or bright specks justify moderate normalization.' ELSE 'A light normalization pass may reduce mild fine grain or bright specks.' END",
     "CASE WHEN review THEN 82 WHEN medium THEN 84 ELSE 78 END", "CASE WHEN review THEN '' ELSE 'watercolor_pencil_cleanup' END", "CASE WHEN review THEN '' WHEN medium THEN 'medium' ELSE 'light' END"),
    *((f"artifact >= {at}", f"'CLEAN_{s.upper()}'", f"'{level}'", f"'{issue} artifact burden'", _ABOVE, _SURE.format(m=f"artifact - {at}", k="1.2"), "'general_artifact_cleanup'", f"'{s}'") for at, s, level, issue in ((75, "strong", "CRITICAL", "High"), (60, "medium", "WARNING", "Elevated"), (45, "light", "WARNING", "Mild"))),
    ("texture >= 75", "'TEXTURE_NORMALIZE_LIGHT'", "'WARNING'", "'High texture burden'", "printf('Texture score is %.2f/100.', texture)", _SURE.format(m="texture - 75", k="1.2"), "'general_artifact_cleanup'", "'light'"),
    ("megapixels > 0 AND megapixels < 1", "'MANUAL_REVIEW'", "'WARNING'", "'Low resolution'", "'Image resolution is below 1 megapixel.'", "70", "''", "''"),
    ("bc < 60", "'MANUAL_REVIEW'", "'WARNING'", "'Brightness outlier'", "'Brightness differs substantially from the dataset median.'", "70", "''", "''"),
    ("cs < 60", "'MANUAL_REVIEW'", "'WARNING'", "'Contrast outlier'", "'Contrast differs substantially from the dataset or useful range.'", "70", "''", "''"),
    ("true", "'KEEP'", "'INFO'", "'No major quality issue'", "'Available evidence does not justify processing.'", "90", "''", "''"),
]
_TOLD = ("action", "level", "issue", "explanation", "confidence", "preset", "strength")


def _told_sql(texture: str) -> str:
    """SQL for what the first rule that holds says."""
    return ", ".join("CASE " + " ".join(f"WHEN {r[0].replace('{texture}', texture)} THEN {r[i]}" for r in _RULES) + f" END AS {name}" for i, name in enumerate(_TOLD, 1))


_AVERAGES = "SELECT *, avg(artifact) OVER () AS aa, avg(microtexture) OVER () AS tm, stddev_pop(microtexture) OVER () AS ts FROM (SELECT *, CAST(n_chars % 61 AS DOUBLE) AS microtexture, CAST(n_tokens % 67 AS DOUBLE) AS highlight_speck, CAST(n_chars % 97 AS DOUBLE) AS edge_sharpness FROM y)"
_TEXTURED = f"""SELECT *, highlight_speck >= 55 OR microtexture >= tm + greatest(20, 1.6 * ts) AND edge_sharpness >= 75 AS review, highlight_speck >= 28 OR microtexture >= tm + greatest(10, ts) AS medium, highlight_speck >= 12 OR microtexture >= tm + greatest(6, 0.5 * ts) AS mild FROM ({_AVERAGES})"""


@query(f"WITH {M}, {_X}, {_Q}, t AS ({_TEXTURED}) SELECT item_id, {_told_sql('false')} FROM t")
def policy_engine(spark, d):
    return _policy(spark, d).select("item_id", *_TOLD)


@query(f"WITH {M}, {_X}, {_Q}, t AS ({_TEXTURED}) SELECT item_id, {_told_sql('(microtexture <> 0 OR highlight_speck <> 0 OR edge_sharpness <> 0) AND (review OR medium OR mild)')} FROM t")
def policy_with_texture(spark, d):
    """The policy where texture is measured as well, on numbers derived from texts' lengths."""
    signals = {"microtexture": F.col("n_chars") % 61, "highlight_speck": F.col("n_tokens") % 67, "edge_sharpness": F.col("n_chars") % 97}
    rows = quality.item_quality(metrics(spark, d)).withColumns({k: v.cast("double") for k, v in signals.items()})
    return quality.policy(rows, {}).select("item_id", *_TOLD)


@query(f"""WITH {M}, {_X}, {_Q}, z AS (SELECT {_POLICY} AS action FROM y) SELECT count(*) AS items, count(*) FILTER (action LIKE 'CLEAN%' OR action LIKE 'TEXTURE%') AS cleaning, count(*) FILTER (action = 'EXCLUDE') AS excluded,
  {_C("60 + 0.55 * avg(CASE action WHEN 'CLEAN_LIGHT' THEN 8 WHEN 'TEXTURE_NORMALIZE_LIGHT' THEN 8 WHEN 'CLEAN_MEDIUM' THEN 14 WHEN 'CLEAN_STRONG' THEN 20 ELSE 0 END) + 8 * count(*) FILTER (action = 'EXCLUDE') / count(*)")} AS projected FROM z""")
def cleanup_rollup(spark, d):
    return quality.cleanup_rollup(_policy(spark, d), 60.0)


@query(f"WITH {M}, {_X}, {_Q} SELECT item_id FROM y WHERE artifact > 50 AND texture < 70 AND contains(lower(grp), 'src1')")
def selection_filter(spark, d):
    return rules.selected(metrics(spark, d), artifact_gt=50, texture_lt=70, grp_contains="SRC1").select("item_id")


@query(f"""WITH {M}, {_X}, s AS (SELECT avg(artifact) AS ma, stddev_pop(artifact) AS sa, avg(texture) AS mt, stddev_pop(texture) AS st FROM x)
SELECT item_id, round(sqrt((pow((artifact - ma) / greatest(sa, 5), 2) + pow((texture - mt) / greatest(st, 5), 2)) / 2), 6) AS distance, round_even(100 * exp(-sqrt((pow((artifact - ma) / greatest(sa, 5), 2) + pow((texture - mt) / greatest(st, 5), 2)) / 2)), 2) AS representative FROM x, s""")
def texture_finalize(spark, d):
    return quality.texture_finalized(metrics(spark, d), ("artifact", "texture")).select("item_id", F.round("distance", 6).alias("distance"), "representative")


_REC = "CASE WHEN artifact >= 75 THEN 'MANUAL_REVIEW' WHEN artifact >= 45 THEN 'DETERMINISTIC_ONLY' ELSE 'LEAVE_ALONE' END"


@query(f"""WITH {M}, {_X}, y AS (SELECT *, {_REC} AS rec, 50 + n_tokens % 50 AS conf, CAST(n_chars % 101 AS DOUBLE) AS cons FROM x),
a AS (SELECT count(*) AS n, count(*) FILTER (rec <> 'LEAVE_ALONE') AS iv, count(*) FILTER (rec = 'MANUAL_REVIEW') AS mr, avg(artifact) AS am, stddev_pop(artifact) AS sm, avg(texture) AS a_s, stddev_pop(texture) AS ss, avg(cons) AS tc, avg(conf) AS mc, avg(conf) FILTER (rec <> 'LEAVE_ALONE') AS nc, count(exact_of) AS dups FROM y),
b AS (SELECT *, round(iv / n, 4) AS ir, round(tc, 1) AS tex, round(100 * exp(-(ss / a_s + sm / am) / 2), 1) AS style FROM a), c AS (SELECT *, CASE WHEN ir >= 1 THEN 0 WHEN ir = 0 THEN 100 ELSE round(100 * (1 - ir) * nc / 100, 1) END AS clean FROM b),
e AS (SELECT *, round(0.55 * tex + 0.25 * style + 0.20 * clean, 1) AS overall FROM c),
g AS (SELECT *, round_even(greatest(0, least(100, 100 - (least(15, mr * 0.5) * CASE WHEN mc > 80 THEN 0.5 ELSE 1 END + CASE WHEN sm > 25 THEN 10 WHEN sm > 15 THEN 5 ELSE 0 END * CASE WHEN overall > 80 THEN 0.75 ELSE 1 END + CASE WHEN ir > 0.8 THEN 20 WHEN ir > 0.6 THEN 10 ELSE 0 END
  + CASE WHEN am - 26.86 > 30 THEN 10 WHEN am - 26.86 > 10 THEN 5 ELSE 0 END + least(15, dups * 3.0) + CASE WHEN am > 50 THEN 8 ELSE 0 END))), 0) AS readiness FROM e)
SELECT n, ir AS intervention_ratio, tex AS texture_consistency, style AS style_consistency, CAST(clean AS DOUBLE) AS cleanup_consistency, overall AS overall_consistency, CAST(readiness AS DOUBLE) AS readiness, round(greatest(0, least(100, 35 + readiness * 0.30 + overall * 0.15 - ir * 20)), 1) AS health FROM g""")
def health_report(spark, d):
    a = F.col("artifact")
    rows = metrics(spark, d).select(
        "status", ladder((a >= 75, "MANUAL_REVIEW"), (a >= 45, "DETERMINISTIC_ONLY"), otherwise="LEAVE_ALONE").alias("recommendation"), (50 + F.col("n_tokens") % 50).alias("confidence"), a.alias("micro"), F.col("texture").alias("smooth"),
        (F.col("n_chars") % 101).cast("double").alias("consistency"), "exact_of",
    )
    return quality.health_report(rows, F.count("exact_of"), F.sum(F.lit(0)))


@query("""WITH r AS (SELECT s_suppkey AS request_id, CASE WHEN s_nationkey % 2 = 0 THEN 'transform' ELSE 'captioner' END AS category FROM supplier), p AS (SELECT p_partkey AS plugin_id, CASE WHEN p_size % 2 = 0 THEN 'transform' ELSE 'captioner' END AS category, p_size AS gain, p_retailprice * 1000000 AS memory FROM part),
b AS (SELECT category, plugin_id, 50 + least(20, gain) - least(5, memory / 1073741824) AS score FROM p QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, plugin_id DESC) = 1) SELECT request_id, plugin_id, round(score, 4) AS score FROM r JOIN b USING (category)""")
def plugin_rank(spark, d):
    """Suppliers ask, parts are the plugins; the registry is reduced to what each request can meet before they are joined."""
    kind = lambda c: F.when(c % 2 == 0, "transform").otherwise("captioner")
    plugins = table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind(F.col("p_size")).alias("category"), F.array(F.lit("cleanup")).alias("capabilities"), F.array().cast("array<string>").alias("presets"), F.col("p_size").cast("double").alias("gain"), F.lit(0.0).alias("gpu"), (F.col("p_retailprice") * 1000000).alias("memory"))
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), kind(F.col("s_nationkey")).alias("category"))
    kinds = asked.select("category").distinct().select(F.col("category").alias("request_id"), "category", F.lit("cleanup").alias("capability"), F.lit("").alias("preset"))
    best = quality.plugin_rank(kinds, plugins).withColumnRenamed("request_id", "category")
    return asked.join(best, "category").select("request_id", "plugin_id", "score")


_SIG = """s AS (SELECT item_id, item_id % 50 = 0 AS ref, item_id % 2 = 0 AS ai, artifact AS mt, CAST(n_chars % 101 AS DOUBLE) AS hs, CAST(n_tokens % 97 AS DOUBLE) AS ws, CAST(n_chars % 83 AS DOUBLE) AS tc FROM x),
g AS (SELECT *, mt - 26.86 AS delta, abs(mt - avg(mt) OVER ()) / greatest(1, stddev_pop(mt) OVER ()) AS far, greatest(0, least(1, (hs - 30) / 70)) AS sp, greatest(0, least(1, (mt - 36.86) / 30)) AS mi, greatest(0, least(1, (70 - ws) / 40)) AS sm, greatest(0, least(1, (50 - tc) / 50)) AS co FROM s),
n AS (SELECT *, 0.9 * sp - greatest(0, least(1, 15 * sp + 8 * mi)) / 100 AS net, greatest(0, least(1, delta / 40)) * 0.5 - 0.7 / (1 + exp(-greatest(-20, least(20, (delta - 20) / 15)))) AS mnet, mi > 0.4 AND ws > 65 AS clash, far < 0.5 AS near FROM g),
r AS (SELECT *, CASE WHEN ref THEN 'is_reference_image' WHEN greatest(round(sp, 3), round(mi, 3), round(sm, 3), round(co, 3)) < 0.05 THEN 'all_signals_minimal' WHEN net < 0.10 AND mi < 0.25 THEN 'low_net_benefit' WHEN near AND sp < 0.30 THEN 'near_dataset_centroid'
  WHEN sp >= 0.30 AND net > 0.15 AND mi < 0.40 THEN 'speck_signal' WHEN mi >= 0.15 AND mi < 0.40 THEN 'mild_microtexture_signal' WHEN mi >= 0.40 AND NOT clash AND ai AND mnet > 0.15 THEN 'microtexture_signal' ELSE 'conflicting_or_uncertain' END AS factor FROM n)"""


@query(f"""WITH {M}, {_X}, {_SIG} SELECT item_id, factor, CASE WHEN factor IN ('is_reference_image', 'all_signals_minimal', 'low_net_benefit', 'near_dataset_centroid') THEN 'LEAVE_ALONE' WHEN factor IN ('speck_signal', 'mild_microtexture_signal') THEN 'DETERMINISTIC_ONLY' WHEN factor = 'microtexture_signal' THEN 'AI_CONSERVATION_CANDIDATE' ELSE 'MANUAL_REVIEW' END AS recommendation,
  CASE factor WHEN 'is_reference_image' THEN 99 WHEN 'conflicting_or_uncertain' THEN least(59, 55 - (CASE WHEN clash THEN 20 ELSE 0 END + CASE WHEN near THEN 15 ELSE 0 END + CASE WHEN mi >= 0.40 AND NOT ai THEN 5 ELSE 0 END))
    ELSE CASE factor WHEN 'all_signals_minimal' THEN 95 WHEN 'low_net_benefit' THEN 88 WHEN 'near_dataset_centroid' THEN 80 WHEN 'speck_signal' THEN 91 WHEN 'mild_microtexture_signal' THEN 80 ELSE 77 END - (CASE WHEN clash THEN 20 ELSE 0 END + CASE WHEN near THEN 15 ELSE 0 END) END AS confidence,
  CAST(round(CASE WHEN factor IN ('is_reference_image', 'all_signals_minimal') THEN 0 WHEN factor = 'microtexture_signal' THEN mnet ELSE net END, 3) AS DOUBLE) AS net_score, clash AND factor NOT IN ('is_reference_image', 'all_signals_minimal', 'microtexture_signal') AS conflicting FROM r""")
def decision_engine(spark, d):
    """Scores of texts stand for an image's texture measures; every second item may be shown to a model."""
    number = lambda c, n: (F.col(c) % n).cast("double")
    s = metrics(spark, d).select("item_id", (F.col("item_id") % 50 == 0).alias("is_reference"), F.col("artifact").alias("microtexture"), number("n_chars", 101).alias("speck"), number("n_tokens", 97).alias("smoothness"), number("n_chars", 83).alias("consistency"))
    return engine.decided(s, F.col("item_id") % 2 == 0).select("item_id", "factor", "recommendation", "confidence", "net_score", "conflicting")


@query(f"""WITH {M}, {_X}, {_Q}, z AS (SELECT *, {_POLICY} AS action FROM y), a AS (SELECT count(*) AS n, count(*) FILTER (action LIKE 'CLEAN%' OR action LIKE 'TEXTURE%') AS cleaning, count(*) FILTER (action = 'EXCLUDE') AS copies, count(*) FILTER (megapixels < 1) AS small,
  avg(artifact) AS art, avg(texture) AS tex, count(DISTINCT round(aspect_ratio, 1)) AS ratios, max(brightness) - min(brightness) AS bright, stddev_pop(brightness) AS spread FROM z),
l AS (SELECT [CASE WHEN 55 < 60 THEN 'Prioritize critical and warning items before dataset use.' END, CASE WHEN cleaning > 0 THEN 'Review ' || cleaning || ' image(s) recommended for non-destructive cleanup.' END, CASE WHEN copies > 0 THEN 'Review ' || copies || ' likely duplicate image(s) before selecting data.' END,
  CASE WHEN small > 0 THEN 'Review ' || small || ' image(s) below 1 megapixel.' END, CASE WHEN art >= 50 THEN 'The dataset has an elevated average artifact burden.' END, CASE WHEN tex >= 65 THEN 'The dataset has an elevated average texture burden.' END,
  CASE WHEN ratios >= 3 THEN 'Mixed aspect ratios: consider grouping crops for workflows that need consistency.' END, CASE WHEN bright >= 30 OR spread >= 15 THEN 'Strong brightness variation: inspect very dark and very bright images for consistency.' END] AS t FROM a)
SELECT CAST(unnest(range(1, len(f) + 1)) AS BIGINT) AS place, unnest(f) AS guidance FROM (SELECT [x FOR x IN t IF x IS NOT NULL] AS f FROM l)""")
def dataset_guidance(spark, d):
    return engine.dataset_guidance(_policy(spark, d), F.lit(55.0))


#: The places of texture that a baseline tells.
_SHARES = {"p10": 0.1, "p90": 0.9}
_MEASURES = ("megapixels", "aspect_ratio", "texture", "artifact", "brightness", "contrast")
_GAMMA = "ln(1.01 / 0.99)"
_SKETCH = f"""b AS (SELECT *, CASE WHEN value = 0 THEN 0 ELSE sign(value) * (ceil(ln(abs(value)) / {_GAMMA}) + 100000) END AS bucket FROM l WHERE value IS NOT NULL),
  t AS (SELECT *, row_number() OVER (PARTITION BY grp, measure ORDER BY bucket) - 1 AS place, count(*) OVER (PARTITION BY grp, measure) AS c FROM b),
  v AS (SELECT grp, measure, place, c, sign(bucket) * exp((abs(bucket) - 100000) * {_GAMMA}) * 0.99 AS mid FROM t),
  r AS (SELECT grp, measure, max(mid) FILTER (place = least(floor(c * 0.1), c - 1)) AS p10, max(mid) FILTER (place = least(floor(c * 0.9), c - 1)) AS p90 FROM v GROUP BY grp, measure),
  s AS (SELECT grp, measure, count(value) AS n, count(*) - count(value) AS errors, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(min(value), 6) AS least, round(max(value), 6) AS most FROM l GROUP BY grp, measure)
  SELECT s.*, round(greatest(least, least(most, p10)), 6) AS p10, round(greatest(least, least(most, p90)), 6) AS p90 FROM s LEFT JOIN r ON r.measure = s.measure AND r.grp IS NOT DISTINCT FROM s.grp"""
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT {{grp}} AS grp, '{m}' AS measure, CASE WHEN n_tokens % 50 = 7 THEN NULL ELSE CAST({m} AS DOUBLE) END AS value FROM x" for m in _MEASURES) + ")"


def _measured(spark, d):
    """Measures of items, of which those with some numbers of words count as failed."""
    failed = F.col("n_tokens") % 50 == 7
    return metrics(spark, d).select("item_id", "grp", *(F.when(~failed, F.col(m).cast("double")).alias(m) for m in _MEASURES))


def _told(states, by=()):
    found = sketches.finish(states, _SHARES, by)
    return found.select(*by, "measure", "n", "errors", *(F.round(c, 6).alias(c) for c in ("mean", "stddev", "least", "most", *_SHARES)))


@query(f"WITH {M}, {_X}, {_LONG.format(grp='1')}, {_SKETCH}".replace("SELECT s.*, round(g", "SELECT s.* EXCLUDE (grp), round(g"))
def baseline_measures(spark, d):
    """The baseline of every measure, with the number of failed ones; percentiles within 1 % from a sketch."""
    return _told(sketches.state(_measured(spark, d), _MEASURES))


@query(f"WITH {M}, {_X}, {_LONG.format(grp='grp')}, {_SKETCH}")
def baseline_updated_by_source(spark, d):
    """Baselines of sources, kept by three batches of which one comes twice and two are merged before the last."""
    path, rows = new_path(spark, "baseline"), _measured(spark, d)
    for batch in (0, 1, 1):
        sketches.update(spark, path, str(batch), rows.filter(F.col("item_id") % 3 == batch), _MEASURES, ["grp"])
    sketches.compact(spark, path, ["grp"])
    sketches.update(spark, path, "1", rows, _MEASURES, ["grp"])  # was merged: nothing is added
    sketches.update(spark, path, "2", rows.filter(F.col("item_id") % 3 == 2), _MEASURES, ["grp"])
    return _told(sketches.load(spark, path, ["grp"]), ["grp"])
