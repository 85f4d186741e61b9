"""Quality of items and health of a dataset, and the ordered policies that turn scores into actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import clamp, half_even, ladder
from curatrix.operators.baseline import medians, total_variation

#: Weights of the components.
IMAGE_WEIGHTS = {"artifact_quality": 0.25, "texture_quality": 0.15, "duplicate_quality": 0.20, "resolution": 0.15, "brightness_consistency": 0.10, "contrast": 0.15}
DATASET_WEIGHTS = {"exact_duplicates": 0.15, "probable_duplicates": 0.10, "artifact_burden": 0.20, "texture_burden": 0.10, "resolution_consistency": 0.15, "brightness_consistency": 0.10, "contrast_consistency": 0.10, "aspect_ratio_consistency": 0.10}
#: The policy's issues, and thresholds of its rules. artifact_medium is what the shipped rules say; without rules it is 55.
THRESHOLDS = {"artifact_light": 45, "artifact_medium": 60, "artifact_strong": 75, "texture_light": 75, "very_low_resolution_mp": 0.25, "low_resolution_mp": 1.0}
CLEANING = ("CLEAN_LIGHT", "CLEAN_MEDIUM", "CLEAN_STRONG", "TEXTURE_NORMALIZE_LIGHT", "TEXTURE_NORMALIZE_MEDIUM")
GAINS = {"CLEAN_LIGHT": 8.0, "CLEAN_MEDIUM": 14.0, "CLEAN_STRONG": 20.0, "TEXTURE_NORMALIZE_LIGHT": 8.0, "TEXTURE_NORMALIZE_MEDIUM": 14.0}


def two(x: Column) -> Column:
    """Clamped to 0..100, two digits."""
    return half_even(clamp(x), 2)


def weighted(weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    return two(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) / total)


def resolution_score(mp: Column) -> Column:
    return ladder((mp <= 0.25, two(mp / 0.25 * 25)), (mp <= 1, two(25 + (mp - 0.25) / 0.75 * 35)), (mp <= 4, two(60 + (mp - 1) / 3 * 40)), otherwise=F.lit(100.0))


def item_quality(df: DataFrame) -> DataFrame:
    """df (artifact, texture, exact_of, probable_of, megapixels, brightness, contrast) with its components and quality.

    Centers are medians of the whole dataset, joined as one row.
    """
    centers = medians(df, "brightness", name="b0").crossJoin(medians(df, "contrast", name="c0"))
    consistent = lambda v, c, penalty: two(100 - F.abs(F.col(v) - F.col(c)) * penalty)
    risk = F.when(F.col("exact_of").isNotNull(), 100.0).when(F.col("probable_of").isNotNull(), 75.0).otherwise(0.0)
    useful = 100 - F.least(F.abs(F.col("contrast") - 35) * 2.2, F.lit(100.0))
    parts = {
        "artifact_quality": 100 - F.col("artifact"), "texture_quality": 100 - F.col("texture"), "duplicate_quality": 100 - risk, "resolution": resolution_score(F.col("megapixels")),
        "brightness_consistency": consistent("brightness", "b0", 2.5), "contrast_score": two(0.6 * consistent("contrast", "c0", 3) + 0.4 * useful),
    }
    scored = df.crossJoin(F.broadcast(centers)).withColumns(parts)
    weights = {("contrast_score" if k == "contrast" else k): w for k, w in IMAGE_WEIGHTS.items()}
    return scored.withColumn("quality", weighted(weights)).drop("b0", "c0")


def dataset_health(df: DataFrame) -> DataFrame:
    """One row: the dataset's components and its score, from one aggregate."""
    share = lambda c: F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0))
    parts = df.agg(
        F.count("*").alias("items"), two(100 * (1 - share("exact_of"))).alias("exact_duplicates"), two(100 * (1 - share("probable_of"))).alias("probable_duplicates"), two(100 - F.avg("artifact")).alias("artifact_burden"),
        two(100 - F.avg("texture")).alias("texture_burden"), total_variation(df, "megapixels", 1.5).alias("resolution_consistency"), total_variation(df, "brightness", 18).alias("brightness_consistency"),
        total_variation(df, "contrast", 15).alias("contrast_consistency"), total_variation(df, "aspect_ratio", 0.35).alias("aspect_ratio_consistency"),
    )
    return parts.withColumn("health", weighted(DATASET_WEIGHTS))


#: Presets, the confidence of a margin, and what is said of texture.
PRESET, TEXTURE_PRESET = "general_artifact_cleanup", "watercolor_pencil_cleanup"
CONFIDENCE_BASE, CONFIDENCE_SCALE, CONFIDENCE_MOST = 68.0, 1.2, 97
TEXTURE_ENDINGS = {
    "TEXTURE_NORMALIZE_LIGHT": "A light normalization pass may reduce mild fine grain or bright specks.",
    "TEXTURE_NORMALIZE_MEDIUM": "Fine texture or bright specks justify moderate normalization.",
    "MANUAL_REVIEW": "Texture and edge signals are unusually strong or conflicting.",
}
#: What a policy reads of texture, where items have it.
SIGNALS = ("microtexture", "highlight_speck", "edge_sharpness")


def _whole(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def policy(df: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """df with action, level, issue, explanation, confidence, preset and strength, by the first rule of the cascade that holds.

    Texture signals (SIGNALS) are held against their mean and spread over df, where it has them; with rules given, an item
    without quality, artifact, texture or resolution is for review. Statistics are one row of one aggregate.
    """
    t = {**THRESHOLDS, "artifact_medium": 55} if rules is None else {**THRESHOLDS, **rules}
    signals = set(SIGNALS) <= set(df.columns)
    stats = df.agg(F.avg("artifact").alias("_aa"), *((F.avg("microtexture").alias("_tm"), F.stddev_pop("microtexture").alias("_ts")) if signals else ()))
    a, mp, tx = F.coalesce("artifact", F.lit(0.0)), F.coalesce("megapixels", F.lit(0.0)), F.coalesce("texture", F.lit(0.0))
    sure = lambda margin, scale=1.0: F.least(F.lit(CONFIDENCE_MOST), _whole(CONFIDENCE_BASE + F.greatest(F.lit(0.0), margin) * CONFIDENCE_SCALE * scale))
    above = (a - F.col("_aa")) / F.col("_aa") * 100
    burden = F.when(F.col("_aa") > 0, F.format_string("Artifact score is %.1f, %.0f%% above the dataset average.", F.bround(a, 1), F.bround(above, 0))).otherwise(F.format_string("Artifact score is %.2f/100.", a))
    row = lambda *x: F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(x, ("action", "level", "issue", "explanation", "confidence", "preset", "strength"), strict=True)))
    cleaned = lambda action, level, issue, at, strength: (a >= t[at], row(action, level, issue, burden, sure(a - t[at]), PRESET, strength))
    review = lambda issue, why, confidence: row("MANUAL_REVIEW", "WARNING", issue, why, confidence, "", "")
    copy = lambda text, of: F.format_string(text, F.col(of).cast("string"))
    steps = [
        (F.col("status") == "error", row("MANUAL_REVIEW", "CRITICAL", "Unreadable image", "The image could not be read or analyzed reliably.", 99, "", "")),
        (F.col("exact_of").isNotNull(), row("EXCLUDE", "CRITICAL", "Exact duplicate", copy("File content matches %s.", "exact_of"), 99, "", "")),
        (F.col("probable_of").isNotNull(), row("DUPLICATE_REVIEW", "WARNING", "Probable duplicate", copy("Visual hash is similar to %s.", "probable_of"), 90, "", "")),
        ((mp != 0) & (mp < t["very_low_resolution_mp"]), row("REGENERATE", "CRITICAL", "Very low resolution", F.format_string(f"Image resolution is %.3f MP, below {t['very_low_resolution_mp']:.2f} MP.", F.bround(mp, 3)), sure(t["very_low_resolution_mp"] - mp, 100.0), "", "")),
    ]
    if signals:
        micro, speck, edge = (F.coalesce(c, F.lit(0.0)) for c in SIGNALS)
        mean, spread = F.coalesce("_tm", F.lit(0.0)), F.coalesce("_ts", F.lit(0.0))
        over = lambda least, share: micro >= mean + F.greatest(F.lit(least), share * spread)
        relation = ladder((micro > mean + 2, "above"), (micro < mean - 2, "below"), otherwise="near")

        def textured(action: str, issue: str, confidence: int) -> Column:
            told = F.format_string(f"Microtexture is %s the dataset average (%.1f versus %.1f). {TEXTURE_ENDINGS[action]}", relation, F.bround(micro, 1), F.bround(mean, 1))
            preset, strength = (TEXTURE_PRESET, "medium" if action.endswith("MEDIUM") else "light") if action != "MANUAL_REVIEW" else ("", "")
            return row(action, "WARNING", issue, told, confidence, preset, strength)

        seen = (micro != 0) | (speck != 0) | (edge != 0)
        steps += [
            (seen & ((speck >= 55) | over(20.0, 1.6) & (edge >= 75)), textured("MANUAL_REVIEW", "Texture signals require review", 82)),
            (seen & ((speck >= 28) | over(10.0, 1.0)), textured("TEXTURE_NORMALIZE_MEDIUM", "Elevated texture burden", 84)),
            (seen & ((speck >= 12) | over(6.0, 0.5)), textured("TEXTURE_NORMALIZE_LIGHT", "Mild texture burden", 78)),
        ]
    if rules is not None:
        without = F.col("artifact").isNull() | F.col("texture").isNull() | F.col("megapixels").isNull()
        steps.append((without, review("Missing analysis evidence", "Required quality, artifact, texture, or resolution metrics are missing.", 96)))
    steps += [
        cleaned("CLEAN_STRONG", "CRITICAL", "High artifact burden", "artifact_strong", "strong"), cleaned("CLEAN_MEDIUM", "WARNING", "Elevated artifact burden", "artifact_medium", "medium"), cleaned("CLEAN_LIGHT", "WARNING", "Mild artifact burden", "artifact_light", "light"),
        (tx >= t["texture_light"], row("TEXTURE_NORMALIZE_LIGHT", "WARNING", "High texture burden", F.format_string("Texture score is %.2f/100.", tx), sure(tx - t["texture_light"]), PRESET, "light")),
        ((mp != 0) & (mp < t["low_resolution_mp"]), review("Low resolution", f"Image resolution is below {t['low_resolution_mp']:g} megapixel.", 70)),
        (F.col("brightness_consistency") < 60, review("Brightness outlier", "Brightness differs substantially from the dataset median.", 70)),
        (F.col("contrast_score") < 60, review("Contrast outlier", "Contrast differs substantially from the dataset or useful range.", 70)),
    ]
    kept = row("KEEP", "INFO", "No major quality issue", "Available evidence does not justify processing.", 90, "", "")
    chosen = ladder(*((F.coalesce(c, F.lit(False)), x) for c, x in steps), otherwise=kept)
    return df.crossJoin(F.broadcast(stats)).withColumn("_p", chosen).select(*df.columns, "_p.*")


def cleanup_rollup(actions: DataFrame, health: float) -> DataFrame:
    """One row: counts of cleaning, excluded and all items, and the health projected after them."""
    gain = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in GAINS.items() for x in kv)), F.col("action")), F.lit(0.0))
    is_one = lambda *names: F.sum(F.when(F.col("action").isin(*names), 1).otherwise(0)).cast("long")
    sums = actions.agg(F.count("*").alias("items"), is_one(*CLEANING).alias("cleaning"), is_one("EXCLUDE").alias("excluded"), F.avg(gain).alias("gain"))
    return sums.select("items", "cleaning", "excluded", two(health + 0.55 * F.col("gain") + 8 * F.col("excluded") / F.col("items")).alias("projected"))


def texture_finalized(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df with its distance from the dataset's center (mean square of z over columns, a spread of 5 at least) and how representative it is."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [(F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(5.0)) for c in columns]
    distance = F.sqrt(sum((x * x for x in z), F.lit(0.0)) / len(columns))
    return df.crossJoin(F.broadcast(stats)).select(*df.columns, distance.alias("distance"), F.bround(100 * F.exp(-distance), 2).alias("representative"))


def health_report(df: DataFrame, duplicates: Column, near: Column, baseline: float = 26.86) -> DataFrame:
    """Readiness and health of a dataset of analyzed items (status, recommendation, confidence, micro, smooth, consistency): one row.

    Penalties are capped each, rewards soften two of them last, and the sum is rounded as a whole number.
    """
    on = F.col("status") == "analyzed"
    when = lambda c, v: F.when(on, F.col(c)) if v is None else F.sum(F.when(on & (F.col(c) == v), 1).otherwise(0))
    s = df.agg(
        F.count("*").alias("n"), F.sum(on.cast("long")).alias("ok"), *(when("recommendation", v).alias(k) for k, v in (("la", "LEAVE_ALONE"), ("ai", "AI_CONSERVATION_CANDIDATE"), ("mr", "MANUAL_REVIEW"))), F.stddev_pop(when("micro", None)).alias("sm"), F.avg(when("micro", None)).alias("am"),
        F.stddev_pop(when("smooth", None)).alias("ss"), F.avg(when("smooth", None)).alias("as"), F.avg(when("consistency", None)).alias("tc"), F.avg(when("confidence", None)).alias("mc"), F.avg(F.when(on & (F.col("recommendation") != "LEAVE_ALONE"), F.col("confidence"))).alias("nc"), duplicates.alias("dups"), near.alias("nears"),
    )
    cv = lambda sd, m: F.when(F.abs(F.col(m)) < 1e-9, 0.0).otherwise(F.col(sd) / F.col(m))
    s = s.withColumn("ir", F.round((F.col("ok") - F.col("la")) / F.greatest(F.col("ok"), F.lit(1)), 4)).withColumn("tex", F.round("tc", 1)).withColumn("style", F.round(100 * F.exp(-(cv("ss", "as") + cv("sm", "am")) / 2), 1))
    s = s.withColumn("clean", ladder((F.col("ir") >= 1, F.lit(0.0)), (F.col("ir") == 0, F.lit(100.0)), otherwise=F.round(100 * (1 - F.col("ir")) * F.coalesce(F.col("nc") / 100, F.lit(1.0)), 1)))
    s = s.withColumn("overall", F.round(0.55 * F.col("tex") + 0.25 * F.col("style") + 0.20 * F.col("clean"), 1))
    gap, bad = F.col("am") - baseline, (F.col("n") - F.col("ok")) / F.col("n")
    review = F.least(F.lit(15.0), F.col("mr") * 0.5) * F.when(F.col("mc") > 80, 0.5).otherwise(1.0)
    spread = ladder((F.col("sm") > 25, F.lit(10.0)), (F.col("sm") > 15, F.lit(5.0)), otherwise=F.lit(0.0)) * F.when(F.col("overall") > 80, 0.75).otherwise(1.0)
    others = [F.least(F.lit(10.0), F.col("ai") * 0.3), ladder((F.col("ir") > 0.8, F.lit(20.0)), (F.col("ir") > 0.6, F.lit(10.0)), otherwise=F.lit(0.0)), ladder((gap > 30, F.lit(10.0)), (gap > 10, F.lit(5.0)), otherwise=F.lit(0.0)), F.least(F.lit(15.0), F.col("dups") * 3.0), F.least(F.lit(8.0), F.col("nears") * 1.0), ladder((bad > 0.15, F.lit(15.0)), (bad > 0.05, F.lit(5.0)), otherwise=F.lit(0.0)), F.when(F.col("am") > 50, 8.0).otherwise(0.0)]
    s = s.withColumn("readiness", F.bround(clamp(100 - sum(others, review + spread)), 0))
    health = F.col("ok") / F.col("n") * 35 + F.col("readiness") * 0.30 + F.col("overall") * 0.15 - F.col("ir") * 20 - F.least(F.lit(30.0), bad * 100)
    return s.select("n", F.col("ir").alias("intervention_ratio"), F.col("tex").alias("texture_consistency"), F.col("style").alias("style_consistency"), F.col("clean").alias("cleanup_consistency"), F.col("overall").alias("overall_consistency"), "readiness", F.round(clamp(health), 1).alias("health"))


def plugin_rank(requests: DataFrame, plugins: DataFrame) -> DataFrame:
    """request_id, plugin_id, score: the best plugin of the asked category and capability (the larger id of equals).

    plugins (id, category, capabilities, presets, gain, gpu, memory) is a registry of a few rows; it is joined by category.
    """
    both = requests.join(plugins.withColumnRenamed("id", "plugin_id"), "category").filter(F.array_contains("capabilities", F.col("capability")))
    value = 50.0 + F.when(F.array_contains("presets", F.col("preset")), 25.0).otherwise(0.0) + F.least(F.lit(20.0), F.col("gain")) - F.least(F.lit(10.0), F.col("gpu") / float(1 << 30) * 2) - F.least(F.lit(5.0), F.col("memory") / float(1 << 30))
    return both.withColumn("score", value).groupBy("request_id").agg(F.max(F.struct("score", "plugin_id")).alias("m")).select("request_id", "m.plugin_id", F.round("m.score", 4).alias("score"))


def capable(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Pairs of requests (required) and providers (supported), by their other columns, whose requirements are all supported.

    An equi-join on each capability, counted: a provider that meets as many as are required meets all. Requests that
    require nothing suit every provider, of which a registry has few.
    """
    who, by = [c for c in requests.columns if c != "required"], [c for c in providers.columns if c != "supported"]
    asked = requests.select(*who, F.array_distinct("required").alias("required"))
    needs = asked.select(*who, F.size("required").alias("_n"), F.explode("required").alias("_c"))
    met = needs.join(providers.select(*by, F.explode(F.array_distinct("supported")).alias("_c")), "_c").groupBy(*who, *by, "_n").agg(F.count("*").alias("_met"))
    free = asked.filter(F.size("required") == 0).select(*who).crossJoin(providers.select(*by))
    return met.filter("_met = _n").select(*who, *by).unionByName(free)
