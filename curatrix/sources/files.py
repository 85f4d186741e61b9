"""Files as relations: images with caption sidecars, reports, manifests, and the tables that runs leave."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.semantics import base_name, path_key, strip, suffix
from curatrix.schemas import MANIFEST
from curatrix.sources.shared import exists, listed

#: What is taken for an image, and what marks a folder as a run's own output: its name, or both of two files.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
OUTPUT, MARKERS = "/inspect_output/", ("inspection_report.json", "recommendation_summary.json")


def images(spark: SparkSession, folder: str, recursive: bool = True, limit: int | None = None, excluded: str | None = None) -> DataFrame:
    """path, length, content, sha of the image files below a folder, but for a run's outputs and what is below `excluded`.

    A limit takes the first by path. Folders that both markers stand in are found by listing those alone; the root isn't one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    found = files.filter(suffix("path").isin(*EXTENSIONS) & ~F.col("path").contains(OUTPUT)).select("path", "length", "content")
    if excluded is not None:
        found = found.filter(~F.contains("path", F.lit(excluded.removeprefix("file:").rstrip("/") + "/")))
    if recursive:
        marks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{','.join(MARKERS)}}}").load(folder)
        parent = F.regexp_replace("path", "/[^/]*$", "")
        own = marks.select(parent.alias("at"), base_name("path").alias("name")).groupBy("at").agg(F.countDistinct("name").alias("n"))
        own = own.filter((F.col("n") == len(MARKERS)) & ~F.col("at").endswith(folder.removeprefix("file://").rstrip("/"))).select("at")
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        inside = found.select("path", F.explode(above).alias("at")).join(own, "at", "left_semi").select("path").distinct()
        found = found.join(inside, "path", "left_anti")
    if limit is not None:
        found = found.orderBy(F.lower("path"), "path").limit(limit)
    return found.withColumn("sha", F.sha2("content", 256))


def stem(path: str) -> Column:
    """The path without its extension: what joins an image to its sidecar."""
    return F.regexp_replace(path_key(path), "\\.[^./]*$", "")


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """stem, caption of the .txt files below a folder; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(stem("path").alias("stem"), F.make_valid_utf8(F.col("content").cast("string")).alias("caption"))


def with_captions(found: DataFrame, texts: DataFrame) -> DataFrame:
    """images with caption (null: missing) and its stripped hash."""
    both = found.withColumn("stem", stem("path")).join(texts, "stem", "left")
    return both.withColumn("caption_sha", F.when(F.col("caption").isNotNull(), F.sha2(strip("caption"), 256))).withColumn("filename", base_name("path"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, gray of what the JVM's reader can decode: luminance, row by row."""
    raw = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, height, width, channels = (batch.column(i).to_pylist() for i in range(4))
            gray = []
            for c, data in zip(channels, batch.column(4), strict=True):
                v = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, c).astype(np.float64)
                gray.append(0.114 * v[:, 0] + 0.587 * v[:, 1] + 0.299 * v[:, 2] if c >= 3 else v[:, 0])
            if gray:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(gray, pa.list_(pa.float64()))], names=["path", "height", "width", "gray"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, height int, width int, gray array<double>")


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report's findings, one row each; fails if the report is of another schema."""
    raw = spark.read.option("multiLine", "true").json(path)
    checked = raw.filter(F.assert_true(F.col("schema") == schema, F.lit(f"the report isn't of schema {schema}")).isNull())
    return checked.select("dataset_path", F.explode("findings").alias("f")).select("dataset_path", "f.*")


def write_manifest(df: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names)).write.option("header", "true").csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with its types; empty strings are null."""
    return spark.read.schema(MANIFEST).option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)


def latest(versions: DataFrame) -> DataFrame:
    """The path of the highest version of each name (name, version, path)."""
    return versions.groupBy("name").agg(F.max_by("path", "version").alias("path"))


def point_to(spark: SparkSession, folder: str, manifest_path: str) -> None:
    """Writes the pointer to a folder's latest manifest."""
    spark.createDataFrame([(manifest_path,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/latest")


def latest_manifest(spark: SparkSession, folder: str) -> str | None:
    """The manifest that the pointer names if it is there; else the last by name of those in the folder, numbers by value, if any."""
    if exists(spark, f"{folder}/latest"):
        named = spark.read.text(f"{folder}/latest").first()
        if named is not None and exists(spark, named.value):
            return named.value
    found = [p for p in listed(spark, folder) if p.rsplit("/", 1)[1].startswith("manifest")]
    return max(found, default=None, key=lambda p: [(x.isdigit(), int(x) if x.isdigit() else 0, x) for x in re.split(r"(\d+)", p.rsplit("/", 1)[1])])


#: A preset's required settings.
PRESET = ("name", "description")


def settings(spark: SparkSession, path: str) -> dict:
    """A file of settings, JSON or TOML by its name, as nested dicts; anything but a table at its top is refused."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    found = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} doesn't hold a table of settings")
    return found


def presets(spark: SparkSession, folder: str) -> DataFrame:
    """name, description, settings (JSON) of the presets in a folder, one file each; fails on one without a name."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select("value", F.input_file_name().alias("path"))
    known = [F.get_json_object("value", f"$.{k}").alias(k) for k in PRESET]
    rows = files.select("path", *known, F.col("value").alias("settings"))
    return rows.filter(F.assert_true(F.col("name").isNotNull(), F.concat(F.lit("a preset without a name: "), "path")).isNull()).select("name", "description", "settings")


def append_audit(df: DataFrame, path: str) -> None:
    df.withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def write_decision_template(items: DataFrame, path: str) -> None:
    """One undecided row for each item, unless the table is there."""
    items.select("item_id", F.lit(None).cast("string").alias("decision"), F.lit("").alias("notes")).write.mode("ignore").parquet(path)


def write_report(findings: DataFrame, path: str, schema: str = "curatrix/findings/v1") -> None:
    """Findings as JSON lines in order of item, analyzer and category."""
    findings.withColumn("schema", F.lit(schema)).orderBy("item_id", "analyzer", "category").write.mode("overwrite").json(path)


def upsert_artifacts(have: DataFrame | None, new: DataFrame) -> DataFrame:
    """Artifacts by plan_id, new ones in place of old; the id is the content's, so the same artifact twice is one."""
    fresh = new.withColumn("artifact_id", F.concat(F.lit("artifact-"), F.substring(F.sha2("content", 256), 1, 24)))
    return fresh if have is None else have.join(fresh.select("plan_id"), "plan_id", "left_anti").unionByName(fresh)
