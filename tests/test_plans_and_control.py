"""The decision engine, plans under control, exact quantiles, near pairs and specks against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import pixels
from curatrix.operators import baseline, controls, duplicates, engine, quality, reports


def plain_engine(mt, hs, ws, tc, ref, ai, mean, spread):
    """What the engine says of one image, step by step."""
    unit = lambda x: max(0.0, min(1.0, x))
    if ref:
        return "LEAVE_ALONE", 99, "is_reference_image", 0.0
    delta, far = mt - 26.86, abs(mt - mean) / max(1.0, spread)
    speck, micro, smooth, even = unit((hs - 30) / 70), unit((delta - 10) / 30), unit((70 - ws) / 40), unit((50 - tc) / 50)
    clash = micro > 0.4 and ws > 65

    def sure(base, *more):
        lost = (20 if clash else 0) + (15 if far < 0.5 else 0) + sum(more)
        return max(0, min(100, base - lost))

    if max(round(x, 3) for x in (speck, micro, smooth, even)) < 0.05:
        return "LEAVE_ALONE", sure(95), "all_signals_minimal", 0.0
    net = 0.9 * speck - unit(15 * speck + 8 * micro) / 100
    if net < 0.10 and micro < 0.25:
        return "LEAVE_ALONE", sure(88), "low_net_benefit", net
    if far < 0.5 and speck < 0.30:
        return "LEAVE_ALONE", sure(80), "near_dataset_centroid", net
    if speck >= 0.30 and net > 0.15 and micro < 0.40:
        return "DETERMINISTIC_ONLY", sure(91), "speck_signal", net
    if 0.15 <= micro < 0.40:
        return "DETERMINISTIC_ONLY", sure(80), "mild_microtexture_signal", net
    if micro >= 0.40 and not clash and ai:
        value = unit(delta / 40) * 0.5 - 0.7 / (1 + math.exp(-max(-20, min(20, (delta - 20) / 15))))
        if value > 0.15:
            return "AI_CONSERVATION_CANDIDATE", sure(87, 10), "microtexture_signal", value
    return "MANUAL_REVIEW", min(59, sure(55, 5 if micro >= 0.40 and not ai else 0)), "conflicting_or_uncertain", net


def test_engine_decides_as_a_plain_version_does(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(0, 100), rng.uniform(0, 110), rng.uniform(0, 100), rng.uniform(0, 100), i % 40 == 0, i % 2 == 0) for i in range(1500)]
    rows += [(2000, 30.0, 10.0, 80.0, 90.0, False, False), (2001, 26.86, 30.0, 70.0, 50.0, False, True)]
    df = spark.createDataFrame(rows, "id long, microtexture double, speck double, smoothness double, consistency double, is_reference boolean, ai boolean")
    mean, spread = np.mean([r[1] for r in rows]), np.std([r[1] for r in rows])
    seen = set()
    for r in engine.decided(df, F.col("ai")).collect():
        want = plain_engine(r.microtexture, r.speck, r.smoothness, r.consistency, r.is_reference, r.ai, mean, spread)
        assert (r.recommendation, r.confidence, r.factor) == want[:3] and r.net_score == pytest.approx(want[3], abs=6e-4)
        seen.add(r.factor)
    assert len(seen) >= 6


def test_guidance_of_no_images_and_of_sound_ones(spark):
    schema = "action string, megapixels double, artifact double, texture double, aspect_ratio double, brightness double"
    said = lambda rows, h: [r.guidance for r in engine.dataset_guidance(spark.createDataFrame(rows, schema), F.lit(h).cast("double")).orderBy("place").collect()]
    assert said([], None) == [engine.GUIDANCE[9]]
    assert said([("KEEP", 2.0, 1.0, 1.0, 1.0, 50.0)] * 3, 90.0) == [engine.GUIDANCE[8]]
    assert said([("EXCLUDE", 0.5, 60.0, 70.0, 1.04, 10.0), ("CLEAN_LIGHT", 2.0, 60.0, 70.0, 1.26, 50.0), ("KEEP", None, 60.0, 70.0, 2.0, None)], 50.0) == [g.format(1) for g in engine.GUIDANCE[:8]]


def plain_control(action, commands):
    """The commands one after another, as a manager would take them."""
    override = locked_action = None
    approval, locked, refused = "proposed", False, 0
    for _, command, value in sorted(commands):
        if command == "reset":
            override = locked_action = None
            approval, locked, refused = "proposed", False, 0
            continue
        if locked and command not in ("unlock", "approve"):
            refused += 1
            continue
        if command == "override":
            override = value
        elif command == "lock":
            locked, approval = True, "approved"
            override = value or override
            locked_action = value or override or action
        elif command == "unlock":
            locked, locked_action = False, None
        else:
            approval = {"approve": "approved", "reject": "rejected"}[command]
    now = locked_action if locked and locked_action else override or action
    return now, approval, "locked" if locked else "overridden" if override else approval, bool(override), locked, approval == "approved" or locked, refused


def test_controls_fold_as_a_plain_version_does(spark):
    rng = random.Random(8)
    plan = [(i, rng.choice(["CLEAN_LIGHT", "KEEP", "EXCLUDE"])) for i in range(200)]
    log, at = {i: [] for i, _ in plan}, 0
    for i, _ in plan:
        for _ in range(rng.randint(0, 7)):
            at += 1
            command = rng.choice(["override", "lock", "unlock", "approve", "reject"])
            log[i].append((at, command, rng.choice(["CLEAN_STRONG", "KEEP"]) if command == "override" or command == "lock" and rng.random() < 0.5 else None))
    commands = spark.createDataFrame([(i, c, v, t) for i, xs in log.items() for t, c, v in xs], "item_id long, command string, value string, at long")
    got = controls.controlled(spark.createDataFrame(plan, "item_id long, action string"), commands)
    for r in got.collect():
        assert (r.action, r.approval, r.status, r.overridden, r.locked, r.eligible, r.refused) == plain_control(dict(plan)[r.item_id], log[r.item_id])
    # a reset undoes what is before it on all items
    at_reset = at // 2
    after = controls.controlled(spark.createDataFrame(plan, "item_id long, action string"), commands.unionByName(spark.createDataFrame([(None, "reset", None, at_reset), (3, "reset", None, at_reset // 2)], commands.schema)))
    for r in after.collect():
        assert (r.action, r.approval, r.status, r.overridden, r.locked, r.eligible, r.refused) == plain_control(dict(plan)[r.item_id], [*(x for x in log[r.item_id] if x[0] != at_reset), (at_reset, "reset", None)])
    with pytest.raises(controls.ApprovalRequired, match="of 200 are left"):
        controls.execution(got, spark.range(150).withColumnRenamed("id", "item_id"), spark.createDataFrame([], "item_id long, action string"))
    controls.require_approved(got, yes=True)
    controls.require_approved(got.filter("approval <> 'proposed'"))
    controls.require_approved(got.limit(0))
    got = got.withColumn("approval", F.when(F.col("approval") == "proposed", "rejected").otherwise(F.col("approval")))
    done = controls.execution(got, spark.range(150).withColumnRenamed("id", "item_id"), spark.createDataFrame([], "item_id long, action string"), limit=5).collect()
    assert len(done) == 200 and sum(r.status == "dry-run" for r in done) == 5
    ran = [r.item_id for r in done if r.status == "dry-run"]
    assert all(r.item_id > max(ran) for r in done if r.reason == "execution limit reached")


def test_approvals_refuse_what_is_unclear(spark):
    previews = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("b", "pending")], "item_id string, approval string")
    updates = spark.createDataFrame([("a", "approved", 1), ("a", "rejected", 2), ("b", "approved", 3), ("c", "approved", 4), ("a", "nope", 5), (" ", "approved", 6), (None, "approved", 7)], "item_id string, state string, at long")
    after, judged = controls.approvals_updated(previews, updates)
    assert sorted((r.item_id, r.approval) for r in after.collect()) == [("a", "rejected"), ("b", "pending"), ("b", "pending")]
    assert {r.at: r.outcome for r in judged.collect()} == {1: "updated", 2: "updated", 3: "ambiguous", 4: "no preview", 5: "unknown state", 6: "no item", 7: "no item"}


def test_exact_places_in_all_and_by_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 1.0, 2.5, rng.random() * 9])) for _ in range(500)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    values = sorted(v for _, v in rows if v is not None)
    assert baseline.medians(df, "v").first()[0] == pytest.approx(np.median(values))
    assert baseline.index_percentiles(df, "v", {"p": 0.9}).first().p == values[int(len(values) * 0.9)]
    for r in baseline.medians(df, "v", "g").collect():
        assert r.median == pytest.approx(np.median([v for g, v in rows if g == r.g and v is not None]))
    assert baseline.medians(df.limit(0), "v").first()[0] is None


def test_equal_vectors_are_no_near_pair(spark):
    base = [((i * 37) % 64) / 64 for i in range(64)]
    near = [x + (0.01 if i % 9 == 0 else 0) for i, x in enumerate(base)]
    rows = [(1, base), (2, base), (3, near), (4, near), (5, [0.5] * 64), (6, [0.5] * 63 + [0.501])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs = duplicates.near_pairs(df)
    assert [(r.first, r.second) for r in pairs.collect()] == [(1, 3)]
    groups = duplicates.near_groups(pairs, duplicates.class_members(df)).collect()
    assert {(r.item_id, r.component, r.n) for r in groups} == {(i, 1, 4) for i in (1, 2, 3, 4)}


def test_requirements_are_met_in_full(spark):
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"]), (3, []), (4, ["z"])], "request_id long, required array<string>")
    have = spark.createDataFrame([(10, ["a", "b", "c"]), (11, ["a"])], "provider_id long, supported array<string>")
    assert {(r.request_id, r.provider_id) for r in quality.capable(asked, have).collect()} == {(1, 10), (2, 10), (2, 11), (3, 10), (3, 11)}


def plain_specks(gray):
    """Components by flood fill, one at a time."""
    signed = gray - pixels.gaussian_blur(gray, 1.2)
    residual = np.abs(signed)
    middle = np.median(residual)
    mask = residual >= max(26.0, middle + 6 * np.median(np.abs(residual - middle)))
    label, n = np.zeros(gray.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < gray.shape[0] and 0 <= b < gray.shape[1] and mask[a, b] and not label[a, b]:
                label[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    found = []
    for k in range(1, n + 1):
        cells = list(zip(*np.nonzero(label == k), strict=True))
        near = {label[y + dy, x + dx] for y, x in cells for dy, dx in pixels._AROUND if 0 <= y + dy < gray.shape[0] and 0 <= x + dx < gray.shape[1]} - {0, k}
        if len(cells) <= 9 and not near:
            found.append((len(cells), float(np.median([residual[c] for c in cells])), float(np.median([signed[c] for c in cells])) > 0))
    return found, float(mask.mean())


def test_isolated_specks_equal_a_plain_version():
    rng = np.random.default_rng(7)
    for _ in range(12):
        gray = rng.normal(120, 3, (48, 60)).clip(0, 255)
        for _ in range(14):
            y, x, s = rng.integers(2, 44), rng.integers(2, 56), rng.integers(1, 4)
            gray[y : y + s, x : x + 1 + rng.integers(0, 2)] += rng.choice([-90, 90])
        found, field = plain_specks(gray)
        got = dict(zip([c.split()[0] for c in pixels.ISOLATED.split(", ")], pixels.isolated(gray), strict=True))
        assert got["components"] == len(found) and got["field_density"] == pytest.approx(field, abs=1e-6)
        if found:
            area, strength, bright = map(np.array, zip(*found, strict=True))
            assert (got["mean_area"], got["max_area"]) == (pytest.approx(area.mean(), abs=1e-4), area.max())
            assert got["median_residual"] == pytest.approx(np.median(strength), abs=1e-3) and got["p95_residual"] == pytest.approx(np.percentile(strength, 95), abs=1e-3)
            assert got["bright_ratio"] == pytest.approx(bright.mean(), abs=1e-4)
    assert pixels.isolated(np.zeros((15, 40))) is None


def test_previews_keep_flat_images():
    flat = np.full((20, 20), 90.0)
    assert pixels.reduce_halo(flat) == pytest.approx(flat) and pixels.reduce_encoding_artifacts(flat) == pytest.approx(flat)
    step = np.where(np.arange(20) < 10, 0.0, 255.0) * np.ones((20, 1))
    assert (pixels.reduce_halo(step) != step).any() and pixels.reduce_halo(step)[:, :5] == pytest.approx(step[:, :5])


def test_reports_are_written_and_read_back(spark, tmp_path):
    findings = spark.createDataFrame([(2, "a/v1", "c.x", "LOW", 0.5), (1, "b/v1", "c.y", "HIGH", 0.4)], "item_id long, analyzer string, category string, severity string, confidence double")
    items = spark.range(1, 4).withColumnRenamed("id", "item_id")
    summary = reports.inspection_summary(items, findings)
    reports.write_report(summary, findings, f"{tmp_path}/r")
    back = spark.read.json(f"{tmp_path}/r/summary").first()
    assert (back.total_images, back.images_clean, back.high) == (3, 1, 1) and spark.read.json(f"{tmp_path}/r/findings").count() == 2
    assert reports.inspection_summary(items.limit(0), findings.limit(0)).first().total_findings == 0
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(50)], "place long, line string")
    reports.write_lines(lines, f"{tmp_path}/t", "place")
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text.splitlines() == [f"line {i}" for i in range(50)]
    said = spark.range(1).select(reports.evidence_line(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("calibrated"), F.lit("no")))).first()[0]
    assert said == "  Evidence: a=1, b=2"
