"""Measurements by content, kept in batches that count once they are whole.

A batch stands in a folder of its own: which item has which content, and the measurements of contents that no earlier batch
has. Its last file says that it's whole; one without is not read and is written anew, so a run that was killed loses a batch
at most. Writers have names: two may measure one content at the same time, and the reader takes the same of both always.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.shared import exists, listed, touch

DONE = "_DONE"


def content_key(content: Column, *versions: str) -> Column:
    """What a measurement is known by: the content, and versions of the schema and of what measures."""
    return F.sha2(F.concat_ws("\x1f", F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256), content.isNull().cast("string"), *map(F.lit, versions)).cast("binary"), 256)


def whole(spark: SparkSession, path: str) -> list[str]:
    """The folders of whole batches, in order of their names."""
    return [p for p in listed(spark, path) if exists(spark, f"{p}/{DONE}")]


def _read(spark: SparkSession, path: str, what: str) -> DataFrame | None:
    parts = [f"{p}/{what}" for p in whole(spark, path)]
    return spark.read.parquet(*parts).withColumn("_batch", F.regexp_extract("_metadata.file_path", f"([^/]*)/{what}/[^/]*$", 1)) if parts else None


def measurements(spark: SparkSession, path: str) -> DataFrame | None:
    """key and measurements of each content once; None before the first batch."""
    rows = _read(spark, path, "measures")
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in ("key", "_batch")]
    return rows.groupBy("key").agg(F.min_by(F.struct(*rest), "_batch").alias("m")).select("key", "m.*")


def items(spark: SparkSession, path: str) -> DataFrame | None:
    """Items with the key of their content, as the last batch that has them says."""
    rows = _read(spark, path, "items")
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in ("item", "_batch")]
    return rows.groupBy("item").agg(F.max_by(F.struct(*rest), F.struct("_batch", "key")).alias("m")).select("item", "m.*")


def measured(spark: SparkSession, path: str) -> DataFrame | None:
    """Items with the measurements of their content."""
    have = items(spark, path)
    return None if have is None else have.join(measurements(spark, path), "key")


def add(rows: DataFrame, path: str, batch: str, measure: Callable[[DataFrame], DataFrame], item: str, content: str, versions: tuple[str, ...] = ("1",)) -> bool:
    """Measures what is new among rows, and says whether anything was done; a batch that is whole already is left as it is.

    measure: takes key and content of rows and returns key and measurements, a row for each. Rows without an item are left out.
    """
    spark, folder = rows.sparkSession, f"{path}/{batch}"
    if exists(spark, f"{folder}/{DONE}"):
        return False
    keyed = rows.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), content_key(F.col(content), *versions).alias("key"), F.col(content).alias("content"))
    keyed.select("item", "key").distinct().write.mode("overwrite").parquet(f"{folder}/items")
    new = spark.read.parquet(f"{folder}/items").groupBy("key").agg(F.min("item").alias("item"))
    known = _read(spark, path, "measures")
    if known is not None:
        new = new.join(known.select("key").distinct(), "key", "left_anti")
    # of an item that stands there more than once with one content any row will do; the join has dealt them by both already
    measure(keyed.join(new, ["key", "item"]).dropDuplicates(["key", "item"]).drop("item")).write.mode("overwrite").parquet(f"{folder}/measures")
    touch(spark, f"{folder}/{DONE}")
    return True
