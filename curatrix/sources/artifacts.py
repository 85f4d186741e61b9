"""Preview artifacts by content, under a log of commits that any number of writers append to.

A commit is a numbered file that names the folder of its records and contents; the number is the version. It is made without
overwriting, so of two writers that want one number one wins, as far as the file system makes that exclusive. The other looks
at what was committed since it read: if no preview of its own is among it, it takes the next number; else it loses, with
nothing of either gone. Folders that no commit names are what failed or lost; they are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.semantics import ladder
from curatrix.sources.shared import create_new, drop_path, listed, unique

#: Formats that are taken, and their files' endings.
FORMATS = {"BMP": ".bmp", "JPEG": ".jpg", "PNG": ".png", "TIFF": ".tiff", "WEBP": ".webp"}
RECORD = ["preview_id", "artifact_id", "sha256", "source_sha256", "reference", "filename", "format", "provider", "n_bytes"]
_SCHEMA = "preview_id string, artifact_id string, sha256 string, source_sha256 string, reference string, filename string, format string, provider string, n_bytes long"


class Conflict(RuntimeError):
    """Another writer has committed an artifact of the same preview since this one read the log."""


def artifact_id(preview_id: Column, sha256: Column) -> Column:
    return F.concat(F.lit("artifact-"), F.substring(F.sha2(F.concat(preview_id, F.lit(":"), sha256), 256), 1, 24))


def commits(spark: SparkSession, folder: str) -> list[str]:
    """The names of the commits' folders, in order; the first is version 1."""
    files = [p for p in listed(spark, f"{folder}/log") if p.endswith(".json")]
    if not files:
        return []
    told = spark.read.text(files).withColumn("_at", F.col("_metadata.file_name")).orderBy("_at").collect()  # one short row a commit
    return [json.loads(r.value)["data"] for r in told]


def records(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """The artifact of each preview as of the last commit that has it (or as of the commits given), with its version."""
    names = commits(spark, folder) if names is None else names
    if not names:
        return spark.createDataFrame([], f"{_SCHEMA}, version long")
    order = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1).cast("long"))))
    rows = spark.read.schema(_SCHEMA).parquet(*(f"{folder}/data/{n}/records" for n in names))
    rows = rows.withColumn("version", F.try_element_at(order, F.regexp_extract("_metadata.file_path", "/data/([^/]*)/records/", 1)))
    rest = [c for c in RECORD if c != "preview_id"]
    return rows.groupBy("preview_id").agg(F.max_by(F.struct(*rest, "version"), "version").alias("m")).select("preview_id", "m.*")


def judged(candidates: DataFrame, previews: DataFrame, have: DataFrame, replace: bool = False) -> DataFrame:
    """candidates (preview_id, content, filename, format, provider) with the columns of records and an outcome each.

    previews: preview_id, source_sha256. Outcomes, the first that holds: "no preview", "ambiguous preview" (several of one id),
    "no content", "unknown format", "same as source", "ambiguous candidate" (different contents for one preview in this
    batch), "unchanged" (the artifact has this content), "exists" (another artifact is there and `replace` is false), "imported".
    """
    known = previews.groupBy("preview_id").agg(F.count("*").alias("_plans"), F.min("source_sha256").alias("source_sha256"))
    rows = candidates.select("preview_id", "content", "filename", "format", "provider", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))
    among = rows.groupBy("preview_id").agg((F.min("sha256") != F.max("sha256")).alias("_several"))
    seen = have.select("preview_id", F.col("sha256").alias("_have"))
    met = rows.join(known, "preview_id", "left").join(among, "preview_id", "left").join(seen, "preview_id", "left")
    endings = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    outcome = ladder(
        (F.col("_plans").isNull(), "no preview"), (F.col("_plans") > 1, "ambiguous preview"), (F.col("content").isNull(), "no content"), (~F.coalesce(F.col("format"), F.lit("")).isin(*FORMATS), "unknown format"),
        (F.col("sha256") == F.col("source_sha256"), "same as source"), (F.col("_several"), "ambiguous candidate"), (F.col("_have") == F.col("sha256"), "unchanged"), (F.col("_have").isNotNull() & F.lit(not replace), "exists"), otherwise="imported",
    )
    reference = F.concat(F.lit("artifacts/"), "preview_id", F.lit("/candidate-"), F.substring("sha256", 1, 16), F.try_element_at(endings, F.col("format")))
    return met.select("preview_id", artifact_id(F.col("preview_id"), F.col("sha256")).alias("artifact_id"), "sha256", "source_sha256", reference.alias("reference"), "filename", "format", "provider", "n_bytes", "content", outcome.alias("outcome"))


class Import:
    """One writer's batch: judged and written on `prepare`, seen by others on `commit`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.name = spark, folder, unique()
        self.based_on = commits(spark, folder)

    @property
    def _data(self) -> str:
        return f"{self.folder}/data/{self.name}"

    def prepare(self, candidates: DataFrame, previews: DataFrame, replace: bool = False) -> DataFrame:
        """Writes what is to be imported, and returns preview_id, artifact_id, filename and outcome of every candidate."""
        rows = judged(candidates, previews, records(self.spark, self.folder, self.based_on), replace)
        rows.write.partitionBy("outcome").parquet(f"{self._data}/judged")
        read = self.spark.read.schema(f"{_SCHEMA}, content binary, outcome string").parquet(f"{self._data}/judged")
        taken = read.filter("outcome = 'imported'")
        first = F.min(F.struct("filename", "provider", *(c for c in RECORD if c not in ("preview_id", "filename", "provider")))).alias("m")
        taken.groupBy("preview_id").agg(first).select("preview_id", *(F.col(f"m.{c}").alias(c) for c in RECORD[1:])).select(*RECORD).write.parquet(f"{self._data}/records")
        return read.select("preview_id", "artifact_id", "filename", "outcome")

    def commit(self) -> int:
        """The version under which the batch is seen from now on; raises Conflict if one of its previews was committed meanwhile."""
        while True:
            now = commits(self.spark, self.folder)
            since = now[len(self.based_on) :]
            if since:
                mine = self.spark.read.schema(_SCHEMA).parquet(f"{self._data}/records").select("preview_id")
                theirs = records(self.spark, self.folder, since).select("preview_id")
                if mine.join(theirs, "preview_id", "left_semi").limit(1).count():
                    raise Conflict(f"version {len(now)} has artifacts of the same previews")
            if create_new(self.spark, f"{self.folder}/log/{len(now) + 1:020d}.json", json.dumps({"data": self.name})):
                return len(now) + 1
            self.based_on = now

    def abandon(self) -> None:
        """Deletes what was written and isn't committed."""
        if self.name not in commits(self.spark, self.folder):
            drop_path(self.spark, self._data)


def resolved(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """artifact_id, content of wanted ids (artifact_id): the bytes of an artifact that is a preview's present one and whose checksum holds; else null."""
    names = commits(spark, folder)
    ids = wanted.select("artifact_id").distinct()
    imported = [p for p in (f"{folder}/data/{n}/judged/outcome=imported" for n in names) if listed(spark, p)]
    if not imported:
        return ids.withColumn("content", F.lit(None).cast("binary"))
    present = records(spark, folder, names).select("artifact_id", F.col("sha256").alias("_sha")).join(ids, "artifact_id", "left_semi")
    stored = spark.read.schema(f"{_SCHEMA}, content binary, outcome string").parquet(*imported)
    sound = stored.select("artifact_id", "content").join(present, "artifact_id").filter(F.sha2("content", 256) == F.col("_sha"))
    return ids.join(sound.groupBy("artifact_id").agg(F.first("content").alias("content")), "artifact_id", "left")


def swept(spark: SparkSession, folder: str) -> int:
    """Deletes the folders that no commit names and returns their number; only while no writer is at work."""
    named = set(commits(spark, folder))
    left = [p for p in listed(spark, f"{folder}/data") if p.rsplit("/", 1)[1] not in named]
    for p in left:
        drop_path(spark, p)
    return len(left)
