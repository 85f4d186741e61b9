"""The decision engine: one conservative recommendation for each item, from texture signals held against the dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import clamp, ladder
from curatrix.operators.quality import CLEANING

#: Fixed values of the engine: baseline of the reference art, zone of no effect, factor of trust in a model.
BASELINE, NEUTRAL, MODEL_TRUST = 26.86, 10.0, 0.5
#: What each source of uncertainty takes from the confidence.
PENALTIES = {"conflicting_signals": 20, "near_dataset_centroid": 10, "limited_ai_track_record": 10, "ai_backend_not_configured": 5}
SIGNALS = ("speck_signal", "microtexture_signal", "smoothness_signal", "consistency_signal")


def _unit(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def decided(df: DataFrame, ai: Column, baseline: float = BASELINE, neutral: float = NEUTRAL, trust: float = MODEL_TRUST) -> DataFrame:
    """df (microtexture, speck, smoothness, consistency, is_reference) with recommendation, confidence, factor, net_score,
    conflicting, uncertainty and the four signals.

    ai: whether a model may be asked. The dataset's mean and spread of microtexture are one aggregate; the rest is one
    projection, in which the first rule that holds decides.
    """
    stats = df.agg(F.avg("microtexture").alias("_mean"), F.stddev_pop("microtexture").alias("_spread"))
    d = F.col("microtexture") - baseline
    df = df.crossJoin(F.broadcast(stats)).withColumn("_delta", d).withColumn("_far", F.abs(F.col("microtexture") - F.col("_mean")) / F.greatest(F.lit(1.0), F.col("_spread")))
    df = df.withColumns({
        "speck_signal": _unit((F.col("speck") - 30) / 70), "microtexture_signal": _unit((F.col("_delta") - neutral) / 30),
        "smoothness_signal": _unit((70 - F.col("smoothness")) / 40), "consistency_signal": _unit((50 - F.col("consistency")) / 50),
    })
    speck, micro, far = F.col("speck_signal"), F.col("microtexture_signal"), F.col("_far")
    clash, near = (micro > 0.4) & (F.col("smoothness") > 65), far < 0.5
    net = 0.9 * speck - _unit(speck * 15 + micro * 8) / 100
    gap = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (F.col("_delta") - 20) / 15))
    model_net = _unit(F.col("_delta") / 40) * trust - 0.7 / (1 + F.exp(-gap))
    small = lambda *names: F.forall(F.array(*(F.round(n, 3) for n in names)), lambda v: v < 0.05)
    doubts = lambda *more: F.array_compact(F.array(F.when(clash, "conflicting_signals"), F.when(near, "near_dataset_centroid"), *more))
    weak_model = F.when(F.lit(trust < 0.6), "limited_ai_track_record")
    no_model = F.when((micro >= 0.40) & ~ai, "ai_backend_not_configured")

    def row(recommendation: str, base: int, factor: str, score: Column, conflict: Column, found: Column, told: Column | None = None, most: int = 100) -> Column:
        taken = F.aggregate(found, F.lit(0), lambda a, x: a + ladder(*((x == k, F.lit(v)) for k, v in PENALTIES.items()), otherwise=F.lit(0))) + F.when(near, 5).otherwise(0)
        sure = F.least(F.lit(most), F.greatest(F.lit(0), F.least(F.lit(100), base - taken)))
        return F.struct(F.lit(recommendation).alias("recommendation"), sure.cast("int").alias("confidence"), F.lit(factor).alias("factor"), F.round(score, 3).alias("net_score"), conflict.alias("conflicting"), (found if told is None else told).alias("uncertainty"))

    none, no = F.array().cast("array<string>"), F.lit(False)
    reference = F.struct(F.lit("LEAVE_ALONE").alias("recommendation"), F.lit(99).alias("confidence"), F.lit("is_reference_image").alias("factor"), F.lit(0.0).alias("net_score"), no.alias("conflicting"), none.alias("uncertainty"))
    chosen = ladder(
        (F.col("is_reference"), reference),
        (small(*SIGNALS), row("LEAVE_ALONE", 95, "all_signals_minimal", F.lit(0.0), no, doubts(), none)),
        ((net < 0.10) & (micro < 0.25), row("LEAVE_ALONE", 88, "low_net_benefit", net, clash, doubts())),
        (near & (speck < 0.30), row("LEAVE_ALONE", 80, "near_dataset_centroid", net, clash, doubts())),
        ((speck >= 0.30) & (net > 0.15) & (micro < 0.40), row("DETERMINISTIC_ONLY", 91, "speck_signal", net, clash, doubts())),
        ((micro >= 0.15) & (micro < 0.40), row("DETERMINISTIC_ONLY", 80, "mild_microtexture_signal", net, clash, doubts())),
        ((micro >= 0.40) & ~clash & ai & (model_net > 0.15), row("AI_CONSERVATION_CANDIDATE", 87, "microtexture_signal", model_net, no, doubts(weak_model))),
        otherwise=row("MANUAL_REVIEW", 55, "conflicting_or_uncertain", net, clash, doubts(no_model), most=59),
    )
    out = df.withColumn("_d", chosen).withColumns({s: F.when(F.col("is_reference"), None).otherwise(F.round(s, 3)) for s in SIGNALS})
    return out.select(*(c for c in out.columns if not c.startswith("_")), "_d.*")


#: The guidance on a dataset, in its order.
GUIDANCE = (
    "Prioritize critical and warning items before dataset use.",
    "Review {} image(s) recommended for non-destructive cleanup.",
    "Review {} likely duplicate image(s) before selecting data.",
    "Review {} image(s) below 1 megapixel.",
    "The dataset has an elevated average artifact burden.",
    "The dataset has an elevated average texture burden.",
    "Mixed aspect ratios: consider grouping crops for workflows that need consistency.",
    "Strong brightness variation: inspect very dark and very bright images for consistency.",
    "No major dataset-level issues require immediate review.",
    "No readable images were available for analysis.",
)


def dataset_guidance(items: DataFrame, health: Column) -> DataFrame:
    """place, guidance: what to do about a dataset of items (action, megapixels, artifact, texture, aspect_ratio, brightness), from one aggregate.

    health: the dataset's score, of the columns of that aggregate or a literal; null where it isn't known. Ratios are told
    apart after rounding to one digit, so they are as few as shapes; three are as good as more.
    """
    is_one = lambda *names: F.count_if(F.col("action").isin(*names))
    ratio = F.round("aspect_ratio", 1)
    s = items.agg(
        F.count("*").alias("n"), is_one(*CLEANING).alias("cleaning"), is_one("EXCLUDE", "DUPLICATE_REVIEW").alias("copies"), F.count_if(F.col("megapixels") < 1).alias("small"), F.avg("artifact").alias("artifact"), F.avg("texture").alias("texture"),
        F.size(F.collect_set(ratio)).alias("ratios"), F.count("brightness").alias("lit"), (F.max("brightness") - F.min("brightness")).alias("range"), F.stddev_pop("brightness").alias("spread"),
    ).withColumn("health", health)
    text = [F.lit(g) if "{}" not in g else None for g in GUIDANCE]
    for i, c in ((1, "cleaning"), (2, "copies"), (3, "small")):
        before, after = GUIDANCE[i].split("{}")
        text[i] = F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after))
    holds = [F.col("health") < 60, F.col("cleaning") > 0, F.col("copies") > 0, F.col("small") > 0, F.col("artifact") >= 50, F.col("texture") >= 65, F.col("ratios") >= 3, (F.col("lit") > 1) & ((F.col("range") >= 30) | (F.col("spread") >= 15))]
    found = F.array_compact(F.array(*(F.when(h, t) for h, t in zip(holds, text, strict=False))))
    said = ladder((F.col("n") == 0, F.array(text[9])), (F.size(found) == 0, F.array(text[8])), otherwise=found)
    return s.select(F.posexplode(said).alias("place", "guidance")).select((F.col("place") + 1).cast("long").alias("place"), "guidance")
