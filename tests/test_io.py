"""Files, stages, pixels and streams."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import pixels
from curatrix.plans import stages
from curatrix.sources import files
from curatrix.streaming import events

DATA = "/root/testdata/sf0.001"


def png(values):
    h, w = values.shape
    chunk = lambda t, d: len(d).to_bytes(4, "big") + t + d + zlib.crc32(t + d).to_bytes(4, "big")
    raw = b"".join(b"\0" + values[y].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_and_sidecars(spark, tmp_path):
    (tmp_path / "sub/inspect_output").mkdir(parents=True)
    grid = np.arange(64).reshape(8, 8) * 3
    for name in ("b.png", "A.PNG", "sub/c.png", "sub/inspect_output/d.png"):
        (tmp_path / name).write_bytes(png(grid))
    (tmp_path / "b.txt").write_bytes(b" a caption \xff")
    (tmp_path / "notes.md").write_text("no image")
    found = files.images(spark, str(tmp_path))
    both = {r.filename: r for r in files.with_captions(found, files.captions(spark, str(tmp_path))).collect()}
    assert set(both) == {"b.png", "A.PNG", "c.png"} and len({r.sha for r in both.values()}) == 1
    assert both["b.png"].caption.startswith(" a caption") and both["A.PNG"].caption is None
    assert [r.path.rpartition("/")[2] for r in files.images(spark, str(tmp_path), limit=1).collect()] == ["A.PNG"]
    (tmp_path / "run/deep").mkdir(parents=True)
    (tmp_path / "run/deep/e.png").write_bytes(png(grid))
    names = lambda **k: {r.path.rpartition("/")[2] for r in files.images(spark, str(tmp_path), **k).select("path").collect()}
    for here in (tmp_path, tmp_path / "run"):
        (here / "inspection_report.json").write_text("{}")
    assert "e.png" in names()
    for here in (tmp_path, tmp_path / "run"):
        (here / "recommendation_summary.json").write_text("{}")
    assert names() == {"b.png", "A.PNG", "c.png"}  # the root's own markers don't count
    assert names(excluded=str(tmp_path / "sub")) == {"b.png", "A.PNG"}
    one = files.pixels(spark, str(tmp_path / "b.png")).first()
    assert (one.height, one.width) == (8, 8) and one.gray == pytest.approx(grid.ravel().tolist())


def test_tables_that_runs_leave(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.png", 3, 1.5, ""), ("b.png", None, None, "y")], "original_path string, file_size long, aspect_ratio double, status string")
    files.write_manifest(rows, f"{tmp_path}/m")
    back = files.manifest(spark, f"{tmp_path}/m")
    assert dict(back.dtypes)["aspect_ratio"] == "double" and {r.status for r in back.collect()} == {None, "y"}
    (tmp_path / "r.json").write_text(json.dumps({"schema": "s/v1", "dataset_path": "d", "findings": [{"item_id": 1}, {"item_id": 2}]}))
    assert files.report(spark, f"{tmp_path}/r.json", "s/v1").count() == 2
    with pytest.raises(Exception, match="schema s/v2"):
        files.report(spark, f"{tmp_path}/r.json", "s/v2").collect()
    for _ in range(2):
        files.write_decision_template(spark.range(3).withColumnRenamed("id", "item_id"), f"{tmp_path}/t")
        files.append_audit(rows, f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3 and spark.read.json(f"{tmp_path}/audit").count() == 4
    art = spark.createDataFrame([("p1", b"x")], "plan_id string, content binary")
    again = files.upsert_artifacts(files.upsert_artifacts(None, art), art.withColumn("content", F.encode(F.lit("y"), "utf-8")))
    assert [bytes(r.content) for r in again.collect()] == [b"y"]


def test_stages_skip_what_is_done(spark, tmp_path):
    ran = []

    def stage(name, requires, config=None):
        return stages.Stage(name, lambda s, have: ran.append(name) or (have[requires[0]].withColumn(name, F.lit(1))), requires, name, config or {})

    a, b = stage("a", ("in",)), stage("b", ("a",))
    go = lambda *x, **k: stages.run(spark, list(x), str(tmp_path), "src", {"in": spark.range(3)}, **k)["b"].count()
    assert go(a, b) == 3 and go(a, b) == 3 and ran == ["a", "b"]
    go(a, stage("b", ("a",), {"x": 1}))
    assert ran == ["a", "b", "b"]
    go(a, b, forced=("a",))
    assert ran[3:] == ["a", "b"]
    with pytest.raises(ValueError):
        stages.validate([b])
    with pytest.raises(ValueError):
        stages.validate([a, a], ("in",))


def test_default_stages_end_in_a_review_queue(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    all_ = stages.default_stages()
    stages.validate(all_, ("records",))
    first = stages.plan(spark, all_, str(tmp_path), "s")
    assert stages.estimate(all_, first) == {"stages": 4, "disk_mb": 0, "ram_mb": 256}
    made = stages.run(spark, all_, str(tmp_path), "s", {"records": docs})
    queue = made["queue"].orderBy("place").collect()
    assert [r.place for r in queue] == list(range(1, len(queue) + 1)) and {r.bucket for r in queue} <= {"PRIORITY_REVIEW", "NEEDS_REVIEW"}
    assert len(queue) == made["recommendations"].filter("bucket <> 'READY_FOR_TRAINING'").count() > 0
    assert {what for _, what, _ in stages.plan(spark, all_, str(tmp_path), "s")} == {"skip"}
    files_ = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    assert stages.source_digest(files_) == stages.source_digest(files_.orderBy("path", ascending=False)) != stages.source_digest(files_.limit(1))


def test_registry(spark):
    r = stages.Registry()
    r.register("add", lambda df, by: df.withColumn("id", F.col("id") + by), {"by": 1})
    assert r.apply("add", spark.range(1), by=5).first().id == 5
    with pytest.raises(TypeError):
        r.apply("add", spark.range(1), nope=1)
    r.enable("add", False)
    assert r.names() == []
    with pytest.raises(RuntimeError):
        r.apply("add", spark.range(1))


def test_texture_of_known_images():
    flat = pixels.texture(np.full((256, 256), 128.0))
    assert (flat[0], flat[6], flat[5]) == (0.0, 42.0, 100.0)
    noise = pixels.texture(np.random.default_rng(42).integers(68, 189, (256, 256)).astype(float))
    assert noise[0] == pytest.approx(88.7, abs=1.5) and noise[6] == pytest.approx(77.1, abs=4)
    assert pixels.texture(np.zeros((2, 9))) is None


def test_pixel_kernels():
    box = np.zeros((40, 40))
    box[10:30, 10:30] = 200
    e = pixels.edges(box)
    assert e.any() and not e[15:25, 15:25].any() and not e[:6].any()
    assert pixels.usm(box)[0] > 0 and pixels.usm(np.zeros((20, 20))) == (0.0,) * 4
    spots = np.zeros((40, 40))
    spots[5, 5] = spots[20, 20] = spots[30:38, 30:38] = 255
    threshold, alone, *_ = pixels.isolated(spots)
    assert threshold == 26.0 and alone == 2
    assert pixels.jpeg_header(b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([10] * 64) + b"\xff\xc0\x00\x11\x08\x00\x10\x00\x10\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01\xff\xda\x00\x02") == (84, "4:2:0")
    assert pixels.jpeg_header(b"no") == (None, None)
    assert pixels.reduce_halo(box).shape == box.shape


def test_streams_equal_their_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, make in (("w", events.windowed), ("s", events.sessions)):
        q = make(events.source(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(batch).collect()))


def test_last_decision_of_a_stream(spark, tmp_path):
    rows = [(1, None, None, "KEEP", "2024-01-01 00:00:00", 1), (1, None, None, "UNDECIDED", "2024-01-02 00:00:00", 2), (2, "c", None, "KEEP", "2024-01-01 00:00:00", 3)]
    schema = "item_id long, category string, analyzer string, decision string, ts string, event_id long"
    for r in rows:
        spark.createDataFrame([r], schema).write.mode("append").parquet(f"{tmp_path}/log")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    q = events.keep_latest(log, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = events.current(spark, f"{tmp_path}/out")
    assert {(r.item_id, r.category): r.decision for r in got.collect()} == {(1, None): "UNDECIDED", (2, "c"): "KEEP"}


def test_pointers_settings_and_presets(spark, tmp_path):
    d = str(tmp_path)
    assert files.latest_manifest(spark, d) is None
    for n in ("manifest-1", "manifest-2"):
        (tmp_path / n).mkdir()
    assert files.latest_manifest(spark, d) == f"{d}/manifest-2"
    files.point_to(spark, d, f"{d}/manifest-1")
    assert files.latest_manifest(spark, d) == f"{d}/manifest-1"
    files.point_to(spark, d, f"{d}/manifest-9")
    assert files.latest_manifest(spark, d) == f"{d}/manifest-2"
    for n in ("manifest-10", "manifest-9b", "manifest"):
        (tmp_path / n).mkdir()
    assert files.latest_manifest(spark, d) == f"{d}/manifest-10"
    (tmp_path / "a.json").write_text('{"name": "a", "description": "first", "x": [1]}')
    (tmp_path / "b.toml").write_text("[t]\nx = 2\n")
    assert files.settings(spark, f"{d}/a.json")["x"] == [1] and files.settings(spark, f"{d}/b.toml") == {"t": {"x": 2}}
    assert [(r.name, r.description) for r in files.presets(spark, d).collect()] == [("a", "first")]
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError, match="table of settings"):
        files.settings(spark, f"{d}/c.json")
    with pytest.raises(Exception, match="without a name"):
        files.presets(spark, d).collect()


def test_scratch_tables_are_bucketed_and_deleted(spark, capsys):
    from curatrix.sources.shared import Scratch, exists, listed, own_dir

    scratch = Scratch(spark)
    a = scratch.bucketed(spark.range(100).withColumnRenamed("id", "k"), "a", "k")
    b = scratch.bucketed(spark.range(50).selectExpr("id AS k", "id * 2 AS v"), "b", "k")
    both = a.join(b.hint("merge"), "k")
    both.explain()
    assert "Exchange" not in capsys.readouterr().out and both.count() == 50
    assert all(exists(spark, p) for p in scratch.paths) and set(scratch.paths) <= set(listed(spark, own_dir(spark)))
    gone = [*scratch.paths]
    scratch.clear()
    assert not any(exists(spark, p) for p in gone)


def test_a_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from curatrix.sources.shared import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
