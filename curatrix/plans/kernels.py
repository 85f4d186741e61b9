"""Pixel kernels on generated grids: integer arithmetic, so both engines make the same pixels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from curatrix.functions import pixels
from curatrix.operators import grids, rules
from curatrix.plans.base import query
from curatrix.sources.shared import table

SIDE = 32
VALUE = "((x * 7 + y * 13 + id * 29) % 61) * 3 + CASE WHEN (x + id) % 11 = 0 THEN 60 ELSE 0 END"
_G = f"g AS (SELECT id, y, x, {VALUE} AS v FROM (SELECT s_suppkey AS id FROM supplier) a, range(0, {SIDE}) b(y), range(0, {SIDE}) c(x))"
_R, _C = "(PARTITION BY id, y ORDER BY x)", "(PARTITION BY id, x ORDER BY y)"


def grid(spark, d, value=VALUE):
    """An image for each supplier, so that there are more of them at greater scales."""
    return grids.grid(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), SIDE, SIDE, value)


@query(f"WITH {_G}, h AS (SELECT *, (coalesce(lag(v) OVER {_R}, v) + v + coalesce(lead(v) OVER {_R}, v)) / 3 AS h FROM g) SELECT id, y, x, round((coalesce(lag(h) OVER {_C}, h) + h + coalesce(lead(h) OVER {_C}, h)) / 3, 6) AS blur FROM h")
def grid_box_blur(spark, d):
    return grids.box_blur(grid(spark, d)).select("id", "y", "x", F.round("blur", 6).alias("blur"))


@query(f"WITH {_G} SELECT a.id, a.y, a.x, max(b.v) AS dilated FROM g a JOIN g b ON a.id = b.id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.id, a.y, a.x")
def grid_dilate(spark, d):
    return grids.dilated(grid(spark, d), 2).select("id", "y", "x", "dilated")


@query(f"WITH {_G} SELECT id, y, x, 4 * v - lag(v) OVER {_R} - lead(v) OVER {_R} - lag(v) OVER {_C} - lead(v) OVER {_C} AS laplacian FROM g QUALIFY laplacian IS NOT NULL")
def grid_laplacian(spark, d):
    return grids.laplacian(grid(spark, d)).select("id", "y", "x", "laplacian")


@query(f"""WITH {_G}, s AS (SELECT id, x % 8 = 0 AS e, abs(v - lag(v) OVER {_R}) AS d FROM g UNION ALL SELECT id, y % 8 = 0, abs(v - lag(v) OVER {_C}) FROM g), m AS (SELECT id, avg(d) FILTER (e) AS a, avg(d) FILTER (NOT e) AS b FROM s GROUP BY id) SELECT id, round(a / greatest(b, 0.25), 6) AS ratio, round(a, 6) AS score FROM m""")
def grid_blocking(spark, d):
    return grids.blocking(grid(spark, d)).select("id", F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


@query(f"WITH {_G}, b AS (SELECT id, y // 8 AS by, x // 8 AS bx, stddev_pop(v) AS s FROM g GROUP BY ALL) SELECT id, round(avg(s), 6) AS contrast, round(100 * exp(-stddev_pop(s) / greatest(avg(s), 1e-6)), 6) AS consistency FROM b GROUP BY id")
def grid_local_contrast(spark, d):
    return grids.local_contrast(grid(spark, d), 8).select("id", F.round("contrast", 6).alias("contrast"), F.round("consistency", 6).alias("consistency"))


@query(f"""WITH {_G}, s AS (SELECT id, v, abs(v - lag(v) OVER {_R}) AS d FROM g UNION ALL SELECT id, v, abs(v - lag(v) OVER {_C}) FROM g), m AS (SELECT id, count(DISTINCT v) AS tones, max(v) - min(v) AS tone_range, avg((d <= 0.75)::INT) AS flat, avg((d >= 20)::INT) AS strong FROM s GROUP BY id)
SELECT id, tones, tone_range, round(flat, 6) AS flat, round(CASE WHEN strong > 0.03 OR tone_range <= 0 THEN 0 ELSE 0.55 * flat + 0.45 * greatest(0, 1 - tones / greatest(1, least(256, tone_range))) END, 6) AS banding FROM m""".replace("((x * 7 + y * 13 + id * 29) % 61) * 3 + CASE WHEN (x + id) % 11 = 0 THEN 60 ELSE 0 END", "((x + y * 2) // (4 + id % 6)) * 7"))
def grid_banding(spark, d):
    soft = grid(spark, d, "((x + y * 2) DIV (4 + id % 6)) * 7")
    return grids.banding(soft).select("id", "tones", "tone_range", F.round("flat", 6).alias("flat"), F.round("banding", 6).alias("banding"))


@query(f"WITH {_G}, b AS (SELECT id, y, x, v > lead(v) OVER {_R} AS b FROM g WHERE y < 8 AND x < 9) SELECT id, string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY y, x) AS bits FROM b WHERE b IS NOT NULL GROUP BY id")
def grid_dhash(spark, d):
    return grids.difference_hash(grid(spark, d).filter("y < 8 AND x < 9"))


@query(f"""WITH {_G}, h AS (SELECT *, (coalesce(lag(v) OVER {_R}, v) + v + coalesce(lead(v) OVER {_R}, v)) / 3 AS h FROM g), s AS (SELECT id, y, x, abs(v - (coalesce(lag(h) OVER {_C}, h) + h + coalesce(lead(h) OVER {_C}, h)) / 3) AS r, coalesce(abs(v - lag(v) OVER {_R}), 0) + coalesce(abs(v - lag(v) OVER {_C}), 0) >= 100 AS e FROM h),
e AS (SELECT a.id, a.y, a.x, a.r, a.e, coalesce(bool_or(b.e AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), false) AS n, coalesce(bool_or(b.e), false) AS f FROM s a JOIN s b ON a.id = b.id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL)
SELECT id, round(coalesce(greatest(0, avg(r) FILTER (n AND NOT e) - coalesce(avg(r) FILTER (NOT f), avg(r))), 0), 6) AS ringing, round(coalesce(avg((r >= 8)::INT) FILTER (n AND NOT e), 0), 6) AS mosquito FROM e GROUP BY id""")
def grid_ringing(spark, d):
    return grids.ringing(grid(spark, d), 100, 1, 2).select("id", F.round("ringing", 6).alias("ringing"), F.round("mosquito", 6).alias("mosquito"))


@query(f"""WITH {_G}, m AS (SELECT id, median(v) AS m FROM g GROUP BY id), a AS (SELECT g.id, m, median(abs(v - m)) AS a FROM g JOIN m USING (id) GROUP BY g.id, m), t AS (SELECT id, greatest(26.0, m + 1.5 * a) AS threshold FROM a)
SELECT g.id, threshold, count(*) FILTER (v > threshold) AS n FROM g JOIN t USING (id) GROUP BY g.id, threshold""")
def grid_robust_outliers(spark, d):
    return grids.robust_outliers(grid(spark, d), k=1.5)


@query(f"WITH {_G} SELECT id, y, x, round(0.299 * v + 0.587 * ((v * 3) % 256) + 0.114 * ((v * 5) % 256), 6) AS gray FROM g")
def grid_gray(spark, d):
    v = F.col("v")
    return grid(spark, d).select("id", "y", "x", F.round(grids.gray(v, (v * 3) % 256, (v * 5) % 256), 6).alias("gray"))


def _gray(spark, d):
    cells = grid(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v")))).alias("c"))
    return cells.select("id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.transform("c", lambda s: s["v"]).alias("gray"))


#: The rules once more, by hand, so that a wrong value in either place shows.
_ENC_SQL = """SELECT item_id, 'source_encoding.jpeg_compression' AS category, CASE WHEN jpeg_quality <= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(least(0.48, CASE WHEN jpeg_quality <= 30 THEN 0.36 ELSE 0.28 END + CASE WHEN jpeg_quality IS NULL THEN 0 ELSE least(0.08, (45 - jpeg_quality) / 250.0) END), 4) AS confidence
  FROM e WHERE is_jpeg AND CASE WHEN jpeg_quality IS NULL THEN bytes_per_pixel <= 0.035 ELSE jpeg_quality <= 45 END
UNION ALL SELECT item_id, 'source_encoding.jpeg_blocking', CASE WHEN block_ratio >= 1.75 AND block_score >= 7 THEN 'MEDIUM' ELSE 'LOW' END, round(least(0.48, CASE WHEN block_ratio >= 1.75 AND block_score >= 7 THEN 0.36 ELSE 0.28 END + least(0.08, (block_ratio - 1.35) * 0.04)), 4) FROM e WHERE is_jpeg AND block_ratio >= 1.35 AND block_score >= 4
UNION ALL SELECT item_id, 'source_encoding.jpeg_ringing', CASE WHEN ringing >= 14 OR mosquito >= 0.045 THEN 'MEDIUM' ELSE 'LOW' END, round(least(0.48, CASE WHEN ringing >= 14 OR mosquito >= 0.045 THEN 0.36 ELSE 0.28 END + least(0.08, ringing / 250.0)), 4) FROM e WHERE is_jpeg AND (ringing >= 9 OR mosquito >= 0.02)
UNION ALL SELECT item_id, 'source_encoding.chroma_artifact', CASE WHEN chroma >= 12 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN chroma >= 12 THEN 0.36 ELSE 0.28 END FROM e WHERE is_jpeg AND chroma >= 7
UNION ALL SELECT item_id, 'source_encoding.banding', CASE WHEN banding >= 0.72 THEN 'MEDIUM' ELSE 'LOW' END, round(least(0.48, CASE WHEN banding >= 0.72 THEN 0.36 ELSE 0.28 END + least(0.08, banding * 0.08)), 4) FROM e WHERE banding >= 0.55 AND tones <= 48 AND tone_range >= 64
UNION ALL SELECT item_id, 'source_encoding.low_source_quality', 'LOW', 0.28 FROM e WHERE is_jpeg AND (pixels <= 32768 OR least_side < 160) AND (bytes_per_pixel <= 0.85 OR coalesce(jpeg_quality <= 45, false))"""


_RGB = f"c AS (SELECT id, y, x, v AS r, (v * 3) % 256 AS g, (v * 5) % 256 AS b FROM g)"


def _channels():
    v = F.col("v")
    return v, (v * 3) % 256, (v * 5) % 256


@query(f"""WITH {_G}, {_RGB}, k AS (SELECT id, (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 AS l, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) * 255 // greatest(r, g, b) ELSE 0 END AS s FROM c)
SELECT id, round(avg(l) / 255 * 100, 2) AS brightness, round(avg(s) / 255 * 100, 2) AS saturation, round(stddev_pop(l) / 127.5 * 100, 2) AS contrast FROM k GROUP BY id""")
def grid_color_statistics(spark, d):
    return grids.color_statistics(grid(spark, d), *_channels())


@query(f"WITH {_G}, {_RGB} SELECT id, sha256(encode('RGB{SIDE}x{SIDE}' || chr(0)) || unhex(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x))) AS pixel_hash FROM c GROUP BY id")
def grid_pixel_hash(spark, d):
    return grids.pixel_hash(grid(spark, d), *_channels())


def _blurred(c: str) -> str:
    h = f"(coalesce(lag({c}) OVER {_R}, {c}) + {c} + coalesce(lead({c}) OVER {_R}, {c})) / 3"
    return f"h{c} AS (SELECT id, y, x, {c}, {h} AS h FROM k), r{c} AS (SELECT id, y, x, abs({c} - (coalesce(lag(h) OVER {_C}, h) + h + coalesce(lead(h) OVER {_C}, h)) / 3) AS r FROM h{c})"


_CHROMA = f"""{_RGB}, k AS (SELECT id, y, x, -0.168736 * r - 0.331264 * g + 0.5 * b + 128 AS cb, 0.5 * r - 0.418688 * g - 0.081312 * b + 128 AS cr FROM c), {_blurred("cb")}, {_blurred("cr")},
s AS (SELECT id, y, x, coalesce(abs(v - lag(v) OVER {_R}), 0) + coalesce(abs(v - lag(v) OVER {_C}), 0) >= 45 AS e FROM g), z AS (SELECT id, y, x, max(e) OVER (PARTITION BY id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS e FROM s),
n AS (SELECT id, y, x, max(e) OVER (PARTITION BY id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS e FROM z),
chroma AS (SELECT id, round(coalesce(quantile_cont(rcb.r + rcr.r, 0.9) FILTER (e), 0), 4) AS chroma FROM n JOIN rcb USING (id, y, x) JOIN rcr USING (id, y, x) GROUP BY id)"""


@query(f"WITH {_G}, {_CHROMA} SELECT * FROM chroma")
def grid_chroma(spark, d):
    return grids.chroma(grid(spark, d), *_channels()).select("id", F.round("chroma", 4).alias("chroma"))


#: Soft shades with bands, so that more than one rule has something to find.
_SHADE = "((x + y * 2 + id) // 8) * 23 % 256 + CASE WHEN id % 3 = 0 THEN (x * 5 + y * 3) % 11 ELSE 0 END"
_GS = _G.replace(VALUE, _SHADE)
_MEASURES = f"""{_GS}, {_CHROMA}, f AS (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS is_jpeg, CASE WHEN s_suppkey % 5 > 0 THEN 20 + s_suppkey % 60 END AS jpeg_quality, 200 + s_suppkey * 37 % 3000 AS size FROM supplier),
st AS (SELECT id, x % 8 = 0 AS e, abs(v - lag(v) OVER {_R}) AS d FROM g UNION ALL SELECT id, y % 8 = 0, abs(v - lag(v) OVER {_C}) FROM g),
bl AS (SELECT id, avg(d) FILTER (e) AS a, avg(d) FILTER (NOT e) AS b, avg((d <= 0.75)::INT) AS flat, avg((d >= 20)::INT) AS strong FROM st GROUP BY id), sh AS (SELECT id, count(*) AS pixels, count(DISTINCT v) AS tones, max(v) - min(v) AS tone_range FROM g GROUP BY id),
bh AS (SELECT id, y, x, v, (coalesce(lag(v) OVER {_R}, v) + v + coalesce(lead(v) OVER {_R}, v)) / 3 AS h FROM g), br AS (SELECT id, y, x, abs(v - (coalesce(lag(h) OVER {_C}, h) + h + coalesce(lead(h) OVER {_C}, h)) / 3) AS r FROM bh),
w5 AS (SELECT id, y, x, max(e) OVER (PARTITION BY id, y ORDER BY x ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS e FROM s), f5 AS (SELECT id, y, x, max(e) OVER (PARTITION BY id, x ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS e FROM w5),
rg AS (SELECT id, coalesce(greatest(0, avg(r) FILTER (n.e AND NOT s.e) - coalesce(avg(r) FILTER (NOT f5.e), avg(r))), 0) AS ringing, coalesce(avg((r >= 8)::INT) FILTER (n.e AND NOT s.e), 0) AS mosquito FROM br JOIN s USING (id, y, x) JOIN n USING (id, y, x) JOIN f5 USING (id, y, x) GROUP BY id),
e AS (SELECT f.id AS item_id, is_jpeg, jpeg_quality, round(size / pixels, 6) AS bytes_per_pixel, round(a / greatest(b, 0.25), 4) AS block_ratio, round(a, 4) AS block_score, round(ringing, 4) AS ringing, round(mosquito, 6) AS mosquito, chroma,
  round(CASE WHEN strong > 0.03 OR tone_range <= 0 THEN 0 ELSE 0.55 * flat + 0.45 * greatest(0, 1 - tones / greatest(1, least(256, tone_range))) END, 4) AS banding, tones, tone_range, pixels, {SIDE} AS least_side FROM f JOIN bl USING (id) JOIN sh USING (id) JOIN rg USING (id) JOIN chroma USING (id))"""


@query(f"WITH {_MEASURES} SELECT item_id, is_jpeg, bytes_per_pixel, block_ratio, block_score, ringing, mosquito, chroma, banding, tones, tone_range, pixels FROM e")
def grid_encoding_measures(spark, d):
    return _encoded(spark, d).select("item_id", "is_jpeg", "bytes_per_pixel", "block_ratio", "block_score", "ringing", "mosquito", "chroma", "banding", "tones", "tone_range", "pixels")


def _encoded(spark, d):
    k = F.col("s_suppkey")
    files = table(spark, d, "supplier").select(k.alias("id"), (k % 2 == 0).alias("is_jpeg"), F.when(k % 5 > 0, 20 + k % 60).alias("jpeg_quality"), (200 + k * 37 % 3000).alias("file_size"))
    return grids.encoding_measures(grid(spark, d, _SHADE.replace("//", "DIV")), *_channels(), files).withColumnRenamed("id", "item_id")


@query(f"WITH {_MEASURES}, r AS ({_ENC_SQL}) SELECT item_id, category, severity, CAST(confidence AS DOUBLE) AS confidence FROM r")
def grid_encoding_findings(spark, d):
    return rules.encoding_findings(_encoded(spark, d))


@query()
def texture_udf(spark, d):
    return pixels.measure(_gray(spark, d), "texture")


@query()
def usm_udf(spark, d):
    return pixels.measure(_gray(spark, d), "usm")


@query()
def components_udf(spark, d):
    return pixels.measure(_gray(spark, d), "isolated")


def _derived(spark, d, sql):
    """The columns of a SELECT over page_id and n, a page's length."""
    columns = sql[len("SELECT ") : sql.index(" FROM (")]
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n")).selectExpr(*re.split(r",\s+(?![^()]*\))", columns))


#: Encoding measurements derived from pages: bytes stand for pixels.
_ENC = """SELECT page_id AS item_id, page_id % 2 = 0 AS is_jpeg, CASE WHEN n % 5 > 0 THEN CAST(n % 100 AS INT) END AS jpeg_quality, n / 100000.0 AS bytes_per_pixel, 1 + n % 9 / 10.0 AS block_ratio, CAST(n % 11 AS DOUBLE) AS block_score, CAST(n % 17 AS DOUBLE) AS ringing, n % 60 / 1000.0 AS mosquito,
  CAST(n % 15 AS DOUBLE) AS chroma, n % 100 / 100.0 AS banding, CAST(n % 70 AS INT) AS tones, CAST(n % 200 AS INT) AS tone_range, n * 10 AS pixels, CAST(n % 400 AS INT) AS least_side FROM (SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM pages)"""


@query(f"WITH e AS ({_ENC}), r AS ({_ENC_SQL}) SELECT item_id, category, severity, CAST(confidence AS DOUBLE) AS confidence FROM r")
def encoding_rules(spark, d):
    return rules.encoding_findings(_derived(spark, d, _ENC))


_ISO = "SELECT page_id AS item_id, CASE WHEN n % 37 = 0 THEN 'error' ELSE 'analyzed' END AS status, n % 40 AS components, CAST(n % 300 AS DOUBLE) AS density, 40.0 + n % 30 AS median_residual, 50.0 + n % 40 AS p95_residual, n % 50 / 1000.0 AS field_density, n % 10 / 20.0 AS edge_ratio, 0.4 + n % 6 / 10.0 AS isolation FROM (SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM pages)"


@query(f"""WITH e AS ({_ISO}) SELECT item_id, 'artifact.high_frequency_isolated.error' AS category, 'LOW' AS severity, CAST(1 AS DOUBLE) AS confidence FROM e WHERE status = 'error'
UNION ALL SELECT item_id, 'artifact.high_frequency_isolated', CASE WHEN density >= 140 THEN 'MEDIUM' ELSE 'LOW' END, CAST(round(least(0.45, CASE WHEN density >= 140 THEN 0.34 ELSE 0.26 END + least(0.08, isolation * 0.08)), 4) AS DOUBLE)
FROM e WHERE status <> 'error' AND components >= 8 AND density >= 60 AND median_residual >= 45 AND p95_residual >= 55 AND field_density <= 0.035 AND edge_ratio <= 0.35 AND isolation >= 0.55""")
def isolated_rules(spark, d):
    e = _derived(spark, d, _ISO)
    e = e.withColumns({c: F.col(c).cast("double") for c in ("median_residual", "p95_residual", "field_density", "edge_ratio", "isolation")})
    return rules.isolated(e).select("item_id", "category", "severity", "confidence")


_TEX = "SELECT page_id AS item_id, CAST(n % 41 AS DOUBLE) AS microtexture, CAST(n % 97 AS DOUBLE) AS smoothness, CAST(n % 83 AS DOUBLE) AS grain, n % 200 / 1000.0 AS edge_density, CAST(n % 53 AS DOUBLE) AS residual_mean, CAST(n % 109 AS DOUBLE) AS residual_p95, CAST(n % 13 AS DOUBLE) AS residual_ratio FROM (SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM pages)"


@query(f"""WITH e AS ({_TEX}) SELECT item_id, 'artifact.crystalline_faceting' AS category, CASE WHEN grain >= 65 THEN 'HIGH' WHEN grain >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(NULL AS DOUBLE) AS confidence FROM e WHERE microtexture >= 20 AND smoothness < 52 AND grain >= 45
UNION ALL SELECT item_id, 'artifact.oversharpening_halo', CASE WHEN residual_mean >= 40 AND residual_p95 >= 90 AND residual_ratio >= 8 THEN 'MEDIUM' ELSE 'LOW' END, CAST(round(least(0.45, CASE WHEN residual_mean >= 40 AND residual_p95 >= 90 AND residual_ratio >= 8 THEN 0.35 + least(0.10, (residual_p95 - 90) / 400) ELSE 0.25 + least(0.10, (residual_p95 - 70) / 300) END), 4) AS DOUBLE) FROM e WHERE edge_density BETWEEN 0.004 AND 0.18 AND residual_mean >= 35 AND residual_p95 >= 70 AND residual_ratio >= 6""")
def texture_rules(spark, d):
    e = _derived(spark, d, _TEX)
    keep = ["item_id", "category", "severity"]
    without = F.lit(None).cast("double").alias("confidence")  # the guard has none of its own
    return rules.crystalline(e).select(*keep, without).unionByName(rules.oversharpening(e).select(*keep, "confidence"))
