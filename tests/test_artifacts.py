"""The store of preview artifacts: outcomes, two writers, failures, lookups."""

import pytest
from pyspark.sql import functions as F

from curatrix.sources import artifacts
from curatrix.sources.shared import Scratch, exists, listed, new_path, own_dir, release


def rows_of(spark, *rows):
    return spark.createDataFrame([(p, None if c is None else c.encode(), f, k, "manual") for p, c, f, k in rows], "preview_id string, content binary, filename string, format string, provider string")


@pytest.fixture
def previews(spark):
    return spark.createDataFrame([("a", "00"), ("b", "00"), ("c", "00"), ("d", "00"), ("d", "01")], "preview_id string, source_sha256 string").withColumn("source_sha256", F.when(F.col("preview_id") == "c", F.sha2(F.lit("source"), 256)).otherwise(F.col("source_sha256")))


@pytest.fixture
def folder(spark):
    return new_path(spark, "artifacts-test")


def told(df):
    return sorted((r.preview_id, r.filename, r.outcome) for r in df.collect())


def put(spark, folder, previews, *rows, replace=False):
    batch = artifacts.Import(spark, folder)
    outcomes = told(batch.prepare(rows_of(spark, *rows), previews, replace))
    batch.commit()
    return outcomes


def present(spark, folder):
    return {r.preview_id: (r.filename, r.version) for r in artifacts.records(spark, folder).collect()}


def test_each_outcome(spark, folder, previews):
    assert put(spark, folder, previews, ("a", "x", "1", "PNG"), ("a", "x", "0", "PNG"), ("c", "source", "2", "PNG"), ("d", "x", "3", "PNG"), ("e", "x", "4", "PNG"), ("b", "x", "5", "GIF"), ("b", None, "6", "PNG")) == [
        ("a", "0", "imported"), ("a", "1", "imported"), ("b", "5", "unknown format"), ("b", "6", "no content"), ("c", "2", "same as source"), ("d", "3", "ambiguous preview"), ("e", "4", "no preview"),
    ]
    assert put(spark, folder, previews, ("b", "x", "1", "PNG"), ("b", "y", "2", "PNG")) == [("b", "1", "ambiguous candidate"), ("b", "2", "ambiguous candidate")]
    assert put(spark, folder, previews, ("a", "x", "9", "PNG")) == [("a", "9", "unchanged")]
    assert put(spark, folder, previews, ("a", "y", "9", "PNG")) == [("a", "9", "exists")]
    assert present(spark, folder) == {"a": ("0", 1)}
    assert put(spark, folder, previews, ("a", "y", "9", "PNG"), replace=True) == [("a", "9", "imported")]
    assert present(spark, folder) == {"a": ("9", 5)}


def test_of_two_writers_one_wins_and_others_lose_nothing(spark, folder, previews):
    first, second, third = (artifacts.Import(spark, folder) for _ in range(3))
    for batch, preview, content in ((first, "a", "x"), (second, "a", "y"), (third, "b", "z")):
        batch.prepare(rows_of(spark, (preview, content, content, "PNG")), previews)
    assert first.commit() == 1
    with pytest.raises(artifacts.Conflict):
        second.commit()
    assert third.commit() == 2
    assert present(spark, folder) == {"a": ("x", 1), "b": ("z", 2)}
    second.abandon()
    first.abandon()  # committed, so it stays
    assert present(spark, folder) == {"a": ("x", 1), "b": ("z", 2)} and len(listed(spark, f"{folder}/data")) == 2


def test_what_is_not_committed_is_never_read_and_can_be_swept(spark, folder, previews):
    put(spark, folder, previews, ("a", "x", "1", "PNG"))
    artifacts.Import(spark, folder).prepare(rows_of(spark, ("b", "y", "2", "PNG")), previews)
    assert present(spark, folder) == {"a": ("1", 1)}
    assert artifacts.swept(spark, folder) == 1 and artifacts.swept(spark, folder) == 0
    assert present(spark, folder) == {"a": ("1", 1)}


def test_only_present_and_sound_artifacts_are_found(spark, folder, previews):
    wanted = lambda *ids: spark.createDataFrame([(i,) for i in ids], "artifact_id string")
    assert [tuple(r) for r in artifacts.resolved(spark, folder, wanted("artifact-0")).collect()] == [("artifact-0", None)]
    put(spark, folder, previews, ("a", "x", "1", "PNG"))
    old = artifacts.records(spark, folder).first().artifact_id
    put(spark, folder, previews, ("a", "y", "1", "PNG"), replace=True)
    new = artifacts.records(spark, folder).first().artifact_id
    found = {r.artifact_id: r.content for r in artifacts.resolved(spark, folder, wanted(old, new, "../x")).collect()}
    assert found == {old: None, new: b"y", "../x": None}


def test_a_failing_job_leaves_neither_files_nor_names(spark):
    paths = []
    with pytest.raises(ZeroDivisionError), Scratch(spark) as scratch, Scratch(spark, on_failure=True) as kept:
        scratch.bucketed(spark.range(5).withColumnRenamed("id", "k"), "t", "k")
        kept.keep(spark.range(5), "u")
        paths += scratch.paths + kept.paths
        1 / 0  # noqa: B018
    assert len(paths) == 2 and not any(exists(spark, p) for p in paths)
    assert not [t.name for t in spark.catalog.listTables() if t.name == f"curatrix_{paths[0][-32:]}"]


def test_kept_tables_stay_when_nothing_fails_and_release_takes_their_names(spark):
    with Scratch(spark, on_failure=True) as kept:
        t = kept.bucketed(spark.range(5).withColumnRenamed("id", "k"), "t", "k")
    assert t.count() == 5 and spark.catalog.tableExists(kept.names[0])
    release(spark)
    assert not spark.catalog.tableExists(kept.names[0]) and not exists(spark, own_dir(spark))
