"""Finding rules: measured items in, rows of the uniform relation of findings out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import contains_term, ladder, sigmoid, tokens
from curatrix.operators.baseline import against, statistics, z_score

SHORT, LONG, IMBALANCE, IMBALANCE_LEAST, FLOOR, CAP = 2, 75, 0.80, 5, 15.0, 0.70
#: Confidence of each caption rule.
CONFIDENCE = {"caption.missing": 0.50, "caption.empty": 0.52, "caption.duplicate": 0.52, "caption.short": 0.42, "caption.long": 0.40, "caption.token_imbalance": 0.44}
CAPTION, LENGTH = "caption/v1", "length/v1"
COLUMNS = ["item_id", "analyzer", "category", "severity", "confidence"]


def _finding(category: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit("LOW").alias("severity"), F.lit(CONFIDENCE[category]).alias("confidence"))


def repeated_hashes(items: DataFrame) -> DataFrame:
    """sha, copies of each text that more than one item has. Only counts are shuffled, so a text of very many items is no hot spot."""
    return items.groupBy("sha").agg(F.count("*").alias("copies")).filter("copies >= 2")


def caption_findings(items: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """Missing and empty texts stop there; others may be duplicated, short or long.

    A missing text is a null sha. Rows are decided in one projection and exploded.
    """
    known = items.join(repeated_hashes(items.filter("n_chars > 0")), "sha", "left")
    rules = F.array_compact(F.array(
        F.when(F.col("copies").isNotNull(), _finding("caption.duplicate")),
        F.when(F.col("n_tokens") <= short, _finding("caption.short")),
        F.when(F.col("n_tokens") >= long, _finding("caption.long")),
    ))
    chosen = ladder((F.col("sha").isNull(), F.array(_finding("caption.missing"))), (F.col("n_chars") == 0, F.array(_finding("caption.empty"))), otherwise=rules)
    return known.select("item_id", F.explode(chosen).alias("f")).select("item_id", F.lit(CAPTION).alias("analyzer"), "f.category", "f.severity", "f.confidence")


def term_shares(items: DataFrame, terms: list[str]) -> DataFrame:
    """term, n (items with it), total, pct: how common each monitored term is among items with text; one pass for all."""
    present = items.filter("n_chars > 0").select(tokens("text").alias("t"))
    counted = present.agg(F.count("*").alias("total"), *(F.sum(contains_term("t", t).cast("long")).alias(f"t{i}") for i, t in enumerate(terms)))
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("n")) for i, t in enumerate(terms)))
    rows = counted.select("total", F.explode(pairs).alias("p")).select("p.term", "p.n", "total")
    return rows.withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("n") / F.col("total"), 1)).otherwise(0.0))


def token_imbalance(items: DataFrame, terms: list[str], share: float = IMBALANCE, least: int = IMBALANCE_LEAST) -> DataFrame:
    """A finding for each item and imbalanced term in it. The terms are a parameter's few, so they are broadcast."""
    common = term_shares(items, terms).filter((F.col("total") >= least) & (F.col("n") >= share * F.col("total")))
    held = items.filter("n_chars > 0").select("item_id", tokens("text").alias("t")).crossJoin(F.broadcast(common.select("term")))
    found = held.filter(contains_term("t", F.col("term")))
    return found.select("item_id", F.lit(CAPTION).alias("analyzer"), F.lit("caption.token_imbalance").alias("category"), F.lit("LOW").alias("severity"), F.lit(CONFIDENCE["caption.token_imbalance"]).alias("confidence"), "term")


def z_severity(z: Column) -> Column:
    return ladder((z >= 3, "CRITICAL"), (z >= 2, "HIGH"), (z >= 1, "MEDIUM"), otherwise="NONE")


def z_confidence(z: Column) -> Column:
    return F.bround(F.least(sigmoid(0.8 * (z - 1.5)), F.lit(CAP)), 4)


def z_findings(items: DataFrame, value: str, category: str, *by: str, analyzer: str = LENGTH, floor: float = FLOOR) -> DataFrame:
    """Items far above their baseline (of all, or of their group): severity by z, never below the floor or without spread."""
    held = against(items, statistics(items, value, *by), *by).filter(F.col(value) >= floor).withColumn("z", z_score(value))
    found = held.filter(F.col("z") >= 1)
    return found.select("item_id", F.lit(analyzer).alias("analyzer"), F.lit(category).alias("category"), z_severity(F.col("z")).alias("severity"), z_confidence(F.col("z")).alias("confidence"), "z")


def all_findings(items: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """The findings of every rule on texts, in one relation."""
    return caption_findings(items, short, long).unionByName(z_findings(items, "n_tokens", "length.high").drop("z"))


def crystalline(df: DataFrame) -> DataFrame:
    hit = df.filter("microtexture >= 20 AND smoothness < 52 AND grain >= 45")
    return hit.withColumn("category", F.lit("artifact.crystalline_faceting")).withColumn("severity", ladder((F.col("grain") >= 65, "HIGH"), (F.col("grain") >= 55, "MEDIUM"), otherwise="LOW")).withColumn("confidence", F.lit(0.45))


def oversharpening(df: DataFrame) -> DataFrame:
    """Items that are far sharper at edges than elsewhere, with a confidence that is capped as long as nothing calibrates it."""
    hit = df.filter("edge_density BETWEEN 0.004 AND 0.18 AND residual_mean >= 35 AND residual_p95 >= 70 AND residual_ratio >= 6")
    hit = hit.filter("status = 'analyzed'") if "status" in df.columns else hit
    medium, p95 = F.expr("residual_mean >= 40 AND residual_p95 >= 90 AND residual_ratio >= 8"), F.col("residual_p95")
    raw = F.when(medium, 0.35 + F.least(F.lit(0.10), (p95 - 90) / 400)).otherwise(0.25 + F.least(F.lit(0.10), (p95 - 70) / 300))
    return hit.withColumns({"category": F.lit("artifact.oversharpening_halo"), "severity": F.when(medium, "MEDIUM").otherwise("LOW"), "confidence": F.round(F.least(raw, F.lit(0.45)), 4)})


def isolated(df: DataFrame) -> DataFrame:
    """Items with few, strong, lone specks; a dense field of them or specks along edges are something else.

    df: status, components, density (by megapixel), median_residual, p95_residual, field_density, edge_ratio, isolation.
    What couldn't be measured is a finding of its own.
    """
    error = F.col("status") == "error"
    lone = F.expr("status = 'analyzed' AND components >= 8 AND density >= 60 AND median_residual >= 45 AND p95_residual >= 55 AND field_density <= 0.035 AND edge_ratio <= 0.35 AND isolation >= 0.55")
    medium = F.col("density") >= 140
    found = df.filter(error | lone)
    confidence = F.round(F.least(F.when(medium, 0.34).otherwise(0.26) + F.least(F.lit(0.08), F.col("isolation") * 0.08), F.lit(0.45)), 4)
    return found.withColumns({
        "category": F.when(error, "artifact.high_frequency_isolated.error").otherwise("artifact.high_frequency_isolated"),
        "severity": F.when(~error & medium, "MEDIUM").otherwise("LOW"), "confidence": F.when(error, 1.0).otherwise(confidence),
    })


#: Fixed values of the encoding rules: category, condition, condition for MEDIUM, what adds to the confidence.
ENCODING = (
    ("source_encoding.jpeg_compression", "is_jpeg AND (jpeg_quality <= 45 OR (jpeg_quality IS NULL AND bytes_per_pixel <= 0.035))", "jpeg_quality <= 30", "CASE WHEN jpeg_quality IS NULL THEN 0D ELSE least(0.08D, (45 - jpeg_quality) / 250D) END"),
    ("source_encoding.jpeg_blocking", "is_jpeg AND block_ratio >= 1.35 AND block_score >= 4", "block_ratio >= 1.75 AND block_score >= 7", "least(0.08D, greatest(0D, block_ratio - 1.35D) * 0.04D)"),
    ("source_encoding.jpeg_ringing", "is_jpeg AND (ringing >= 9 OR mosquito >= 0.020)", "ringing >= 14 OR mosquito >= 0.045", "least(0.08D, ringing / 250D)"),
    ("source_encoding.chroma_artifact", "is_jpeg AND chroma >= 7", "chroma >= 12", "0D"),
    ("source_encoding.banding", "banding >= 0.55 AND tones <= 48 AND tone_range >= 64", "banding >= 0.72", "least(0.08D, banding * 0.08D)"),
    ("source_encoding.low_source_quality", "(pixels <= 32768 OR least_side < 160) AND is_jpeg AND (bytes_per_pixel <= 0.85 OR jpeg_quality <= 45)", "false", "0D"),
)


def encoding_findings(df: DataFrame, key: str = "item_id") -> DataFrame:
    """key, category, severity, confidence for every encoding rule that holds; nulls in a measurement count as not holding."""

    def one(name: str, when: str, medium: str, more: str) -> Column:
        strong = F.expr(f"coalesce({medium}, false)")
        confidence = F.round(F.least(F.lit(0.48), F.when(strong, 0.36).otherwise(0.28) + F.coalesce(F.expr(more), F.lit(0.0))), 4)
        found = F.struct(F.lit(name).alias("category"), F.when(strong, "MEDIUM").otherwise("LOW").alias("severity"), confidence.alias("confidence"))
        return F.when(F.expr(f"coalesce({when}, false)"), found)

    return df.select(key, F.explode(F.array_compact(F.array(*(one(*rule) for rule in ENCODING)))).alias("f")).select(key, "f.category", "f.severity", "f.confidence")


def resolved_policy(defaults: DataFrame, overrides: DataFrame, key: str = "analyzer") -> DataFrame:
    """defaults with each setting that overrides give for the key."""
    settings = [c for c in defaults.columns if c != key]
    other = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in settings if c in overrides.columns))
    return defaults.join(other, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in overrides.columns else F.col(c) for c in settings))


def selected(df: DataFrame, **criteria) -> DataFrame:
    """Rows that meet all criteria: name=value, name_gt, name_lt, name_contains; all=True selects every row."""
    tests = []
    for name, value in criteria.items():
        if name == "all":
            tests.append(F.lit(bool(value)))
        elif name.endswith(("_gt", "_lt")):
            tests.append(F.col(name[:-3]) > value if name.endswith("_gt") else F.col(name[:-3]) < value)
        elif name.endswith("_contains"):
            tests.append(F.contains(F.lower(F.col(name[:-9])), F.lit(str(value).lower())))
        else:
            tests.append(F.upper(F.col(name).cast("string")) == str(value).upper())
    if not tests:
        raise ValueError("a selection needs a criterion")
    return df.filter(reduce(lambda a, b: a & b, tests))
