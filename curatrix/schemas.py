"""The relations of a curation run, and the order of their enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
BUCKETS = ("PRIORITY_REVIEW", "NEEDS_REVIEW", "READY_FOR_TRAINING")
DECISIONS = ("KEEP", "ACCEPTED_STYLE_FALSE_POSITIVE", "IMPROVEMENT_CANDIDATE", "REMOVAL_CANDIDATE", "UNDECIDED")

FINDINGS = "item_id long, analyzer string, category string, severity string, confidence double, evidence string"
#: A manifest's columns have types here, so that a CSV is read back as it was written.
MANIFEST = (
    "original_path string, filename string, extension string, file_size long, image_width int, image_height int, aspect_ratio double, megapixels double, color_mode string, "
    "average_brightness double, average_saturation double, average_contrast double, perceptual_hash string, file_hash string, texture_score double, artifact_score double, "
    "exact_duplicate_of string, probable_duplicate_of string, overall_quality_score double, duplicate_risk double, resolution_score double, brightness_consistency_score double, "
    "contrast_score double, status string, preset_name string, preset_description string, preset_source string"
)


def rank_of(value: Column | str, order: tuple[str, ...] = SEVERITIES) -> Column:
    """Place in the enumeration, from 0; null for what isn't in it."""
    column = F.col(value) if isinstance(value, str) else value
    at = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(at > 0, (at - 1).cast("int"))


def severity_of(rank: Column | str) -> Column:
    column = F.col(rank) if isinstance(rank, str) else rank
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), column.cast("int") + 1)


def checked(findings):
    """findings, failing at the first row whose severity or confidence is out of range."""
    ok = rank_of("severity").isNotNull() & F.col("confidence").between(0, 1)
    return findings.filter(F.assert_true(ok, F.lit("a finding's severity or confidence is out of range")).isNull())
