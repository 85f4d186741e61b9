"""What is said of a whole dataset, and plans for its items: texture, reports, tiers, corpora and preservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.semantics import clamp, ladder
from curatrix.operators.decisions import applied
from curatrix.operators.quality import CLEANING, GAINS, two
from curatrix.sources.shared import large

#: What texture is measured by; weights of what an image should be free of.
TEXTURE = ("microtexture", "local_contrast", "edge_sharpness", "highlight_speck", "consistency")
BURDEN = (0.52, 0.30, 0.18)


def texture_items(df: DataFrame) -> DataFrame:
    """df (TEXTURE) with delta (from the mean), representative, cleanliness and outlier (above, below or null), against one row of statistics."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in TEXTURE for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [(F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(5.0)) for c in TEXTURE]
    distance = F.sqrt(sum((x * x for x in z), F.lit(0.0)) / len(TEXTURE))
    micro, mean = F.col("microtexture"), F.col("_m_microtexture")
    far = F.greatest(F.lit(8.0), F.col("_s_microtexture"))
    burden = BURDEN[0] * micro + BURDEN[1] * F.col("highlight_speck") + BURDEN[2] * F.greatest(F.lit(0.0), F.col("edge_sharpness") - F.col("local_contrast"))
    held = df.crossJoin(F.broadcast(stats))
    return held.select(*df.columns, F.bround(micro - mean, 2).alias("delta"), two(100 * F.exp(-distance)).alias("representative"), two(100 - burden).alias("cleanliness"), F.when(micro > mean + far, "above").when(micro < mean - far, "below").alias("outlier"))


def texture_summary(rated: DataFrame, name: str = "item_id") -> DataFrame:
    """One row of texture_items: mean and spread, outliers, and the items that stand out; the greater name of equals, for the least the lesser."""
    top = lambda c: F.max(F.struct(F.col(c), F.col(name)))[name]
    return rated.agg(
        F.count("*").alias("analyzed"), two(F.avg("microtexture")).alias("average"), two(F.stddev_pop("microtexture")).alias("deviation"), F.count_if(F.col("outlier") == "above").alias("above"), F.count_if(F.col("outlier") == "below").alias("below"),
        top("microtexture").alias("most_over_textured"), F.min(F.struct("microtexture", name))[name].alias("most_under_textured"), top("representative").alias("most_representative"), top("cleanliness").alias("cleanest"),
    )


def dataset_report(df: DataFrame, k: int = 5) -> DataFrame:
    """section, place, item_id, value: averages and copies of readable items, and the k of the most artifacts, the first by id of equals."""
    valid = df.filter("status <> 'error'")
    s = valid.agg(F.count("*").cast("double").alias("total_images"), F.count("exact_of").cast("double").alias("duplicate_count"), F.count("probable_of").cast("double").alias("probable_duplicate_count"), F.round(F.avg("megapixels"), 4).alias("average_megapixels"), F.round(F.avg("texture"), 2).alias("average_texture_score"), F.round(F.avg("artifact"), 2).alias("average_artifact_score"))
    sums = s.select(F.explode(F.array(*(F.struct(F.lit(c).alias("section"), F.col(c).alias("value")) for c in s.columns))).alias("r")).select("r.section", F.lit(1).cast("long").alias("place"), F.lit(None).cast("long").alias("item_id"), "r.value")
    first = valid.select("item_id", "artifact").orderBy(F.desc("artifact"), "item_id").limit(k)  # a top-k; the window is over k rows
    ranked = first.select(F.lit("highest_artifact").alias("section"), F.row_number().over(Window.orderBy(F.desc("artifact"), "item_id")).cast("long").alias("place"), F.col("item_id").cast("long").alias("item_id"), F.col("artifact").alias("value"))
    return sums.unionByName(ranked)


def faceting_cluster(grain: Column, smooth: Column) -> Column:
    """Which kind of finding a faceted image is: D another texture, A likely real, B style, C at the threshold's fringe."""
    return ladder((smooth < 38, "D"), (grain >= 55, "A"), ((grain >= 50) & (smooth < 45), "B"), otherwise="C")


def faceting_tier(grain: Column) -> Column:
    return ladder((grain >= 65, "HIGH"), (grain >= 55, "MEDIUM"), otherwise="LOW")


def faceting_tiers(df: DataFrame) -> DataFrame:
    """cluster, tier, n, mean_grain of faceted images (grain, smoothness)."""
    rows = df.select("grain", faceting_cluster(F.col("grain"), F.col("smoothness")).alias("cluster"), faceting_tier(F.col("grain")).alias("tier"))
    return rows.groupBy("cluster", "tier").agg(F.count("*").alias("n"), F.round(F.avg("grain"), 4).alias("mean_grain"))


#: Actions that leave an item's quality as it is, and the quality that a new picture should have.
UNCHANGED, HEALTHY = ("EXCLUDE", "DUPLICATE_REVIEW", "MANUAL_REVIEW"), 75.0
STRENGTH = {"CLEAN_LIGHT": "light", "CLEAN_MEDIUM": "medium", "CLEAN_STRONG": "strong", "TEXTURE_NORMALIZE_LIGHT": "light", "TEXTURE_NORMALIZE_MEDIUM": "medium"}


def cleanup_decisions(df: DataFrame, plugin_gain: Column | None = None) -> DataFrame:
    """item_id, action, strength, before, after, gain, benefit, disk of each item (action, quality, file_size).

    plugin_gain: what the item's plug-in is expected to add; null where none is enabled.
    """
    a, before = F.col("action"), F.col("quality")
    own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in GAINS.items() for x in kv)), a), F.lit(0.0))
    gain = own if plugin_gain is None else F.greatest(own, F.coalesce(plugin_gain, F.lit(0.0)))
    gain = ladder((a.isin(*UNCHANGED), F.lit(0.0)), (a == "REGENERATE", F.greatest(F.lit(20.0), HEALTHY - before)), otherwise=gain)
    after = F.when(a.isin(*UNCHANGED), before).otherwise(F.least(F.lit(100.0), before + F.col("gain")))
    benefit = F.when(F.col("gain") > 0, F.format_string("+%.1f estimated quality points", "gain")).otherwise("No automatic quality gain estimated")
    strength = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STRENGTH.items() for x in kv)), a), F.lit(""))
    disk = F.when(a.isin(*CLEANING, "REGENERATE"), F.col("file_size")).otherwise(0).cast("long")
    rows = df.withColumn("gain", gain)
    return rows.select("item_id", "action", strength.alias("strength"), F.round(before, 2).alias("before"), F.round(after, 2).alias("after"), F.round("gain", 2).alias("gain"), benefit.alias("benefit"), disk.alias("disk"))


def corpus_check(paths: DataFrame, found: DataFrame) -> DataFrame:
    """One row: groups, paths that are there, that may be missing, and that must not be. paths (corpus, path, optional, private); found (path)."""
    both = paths.join(found.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    free = F.col("optional") | F.col("private")
    missing = F.col("_there").isNull()
    return both.agg(F.countDistinct("corpus").alias("groups"), F.count("_there").alias("existing"), F.count_if(missing & free).alias("skipped_optional"), F.count_if(missing & ~free).alias("missing_required"))


def missing_paths(paths: DataFrame, found: DataFrame) -> DataFrame:
    """The paths that must be there and aren't."""
    return paths.filter("NOT optional AND NOT private").select("path").distinct().join(found.select("path"), "path", "left_anti")


def preservation(before: DataFrame, after: DataFrame, bins: int = 64) -> DataFrame:
    """id, pixel_difference, histogram_difference: how far an image (id, y, x, v) is from what it was.

    The second is the Bhattacharyya distance of histograms.
    """
    one, two_ = before.select("id", "y", "x", "v", F.lit(1).alias("a")), after.select("id", "y", "x", F.col("v").alias("w"), F.lit(1).alias("b"))
    return changed(one.join(large(two_), ["id", "y", "x"], "full_outer"), bins)


def changed(both: DataFrame, bins: int = 64) -> DataFrame:
    """The same of pixels with what they became (id, v, w; a and b: 1 if there before, and after, else null).

    Differences and both histograms are sums by bin, of one pass; an image has a row for each of its bins then.
    """
    bin_ = lambda v: F.floor(F.col(v) * bins / 256).alias("bin")
    zero, met = F.lit(0), F.col("a") + F.col("b")
    apart = F.when(met.isNotNull(), F.abs(F.col("v") - F.col("w")))
    told = F.struct(bin_("v"), F.coalesce("a", zero).alias("a"), zero.alias("b"), apart.alias("d"), met.isNotNull().alias("met"))
    became = F.struct(bin_("w"), zero.alias("a"), F.coalesce("b", zero).alias("b"), F.lit(None).cast("double").alias("d"), F.lit(False).alias("met"))
    each = both.filter("id IS NOT NULL").select("id", F.explode(F.array(told, became)).alias("s")).select("id", "s.*")
    binned = each.groupBy("id", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("d").alias("d"), F.count("d").alias("k"), F.count_if("met").alias("met"))
    common = F.when(F.col("bin").isNotNull(), F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0)
    sums = binned.groupBy("id").agg(F.sum(common).alias("s"), F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum("d").alias("d"), F.sum("k").alias("k"), F.sum("met").alias("met")).filter("met > 0")
    distance = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("s") / F.sqrt(F.col("n") * F.col("m"))))
    return sums.select("id", F.round(F.when(F.col("k") > 0, F.col("d") / F.col("k")), 6).alias("pixel_difference"), F.round(distance, 6).alias("histogram_difference"))


def accepted(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """metrics with accepted, and the reason for what isn't: each metric over its limit, in order."""
    said = F.array_compact(F.array(*(F.when(F.col(m) > limit, F.format_string(f"{m.replace('_', ' ')} %.6f exceeds {limit:.6f}", m)) for m, limit in limits.items())))
    return metrics.withColumn("reason", F.array_join(said, "; ")).withColumn("accepted", F.col("reason") == "")


def first_decided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """item_id, decision: of an item's findings, in the order of category, analyzer and severity, the first that a decision applies to.

    A decision on the whole item applies to any finding that none of narrower scope does, so to the first one already.
    decisions: (item_id, category, analyzer, decision); null category and analyzer for a whole item. A minimum over structs.
    """
    each = applied(findings.select("item_id", "category", "analyzer", "severity").distinct(), decisions)
    met = F.when(F.col("decision").isNotNull(), F.struct("category", "analyzer", "severity", "decision"))
    return each.groupBy("item_id").agg(F.min(met).alias("m")).select("item_id", F.col("m.decision").alias("decision"))


def explanation(category: Column, value: Column, mean: Column, z: Column) -> Column:
    """A finding in words, in a fixed format."""
    return F.format_string("%s: %.1f against a mean of %.1f (z %+.2f)", category, value, mean, z)


def crosshatch(spacing: int, amplitude: int, base: int = 128) -> str:
    """SQL over x and y for a generated defect: lines a cell wide at 45 and 135 degrees."""
    line = lambda e: f"CASE WHEN (({e}) % {spacing} + {spacing}) % {spacing} = 0 THEN {amplitude} ELSE 0 END"
    return f"greatest(0, {base} - {line('y - x')} - {line('y + x')})"


def paced(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "value", within: int = 86400) -> DataFrame:
    """events with what came before each by key: the last value, the quarter it stands in, and sums over the time `within` (seconds) before.

    An extension: frames by rows, by rank and by range of time.
    """
    order = Window.partitionBy(key).orderBy(time, "event_id")
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    recent = Window.partitionBy(key).orderBy(seconds).rangeBetween(-within * 1_000_000, 0)
    return events.select("event_id", key, F.lag(value).over(order).alias("previous"), F.ntile(4).over(order).alias("quarter"), F.round(F.cume_dist().over(order), 6).alias("share"), F.count("*").over(recent).alias("recent"), F.round(F.sum(value).over(recent), 4).alias("recent_total"))
