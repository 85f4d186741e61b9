"""Traps of single operators, and cases that the tables don't hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curatrix import schemas
from curatrix.functions import semantics as S
from curatrix.operators import summaries, baseline, calibrate, compare, decisions, duplicates, graph, numbering, quality, rollup, rules, triage
from curatrix.operators.items import measured


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    assert one(spark, S.strip(F.lit("\t a \n b\x0b "))) == "a \n b"
    assert one(spark, S.tokens(F.lit("Don't é_x 8K"))) == ["don't", "_x", "8k"]
    assert one(spark, S.contains_term(S.tokens(F.lit("a Best, quality!")), "best quality")) is True
    assert one(spark, S.contains_term(S.tokens(F.lit("bestquality 18k")), "8k")) is False
    assert one(spark, S.score(F.lit(12.0), 12.0)) == round(100 * (1 - math.exp(-1)), 2)
    assert one(spark, S.score(F.lit(-3.0), 12.0)) == 0.0
    assert one(spark, S.hex_hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000001"))) == 63
    assert one(spark, S.base_name(F.lit("a\\b/C.PNG"))) == "C.PNG" and one(spark, S.suffix(F.lit("a\\b/C.PNG"))) == ".png"
    assert one(spark, S.evidence_text(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)))) == "a=1, b=2"
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) == 0.0 and one(spark, S.ratio(F.lit(1), F.lit(0), empty=None)) is None
    assert one(spark, S.short_id("preview-", F.lit("x"))).startswith("preview-")


def test_percentiles_are_by_place(spark):
    df = spark.range(20).withColumn("v", F.col("id"))
    assert tuple(baseline.index_percentiles(df, "v", {"p10": 0.1, "p90": 0.9, "p100": 1.0}).first()) == (2, 18, 19)


def test_caption_rules_stop_at_missing_and_empty(spark):
    rows = [(1, None), (2, "  "), (3, "hi"), (4, "hi "), (5, " ".join(["w"] * 80)), (6, " ".join(["w"] * 80))]
    items = measured(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string"))
    missing = items.withColumn("sha", F.when(F.col("item_id") != 1, F.col("sha")))
    got = {}
    for r in rules.caption_findings(missing).collect():
        got.setdefault(r.item_id, set()).add(r.category)
    assert got == {1: {"caption.missing"}, 2: {"caption.empty"}, 3: {"caption.duplicate", "caption.short"}, 4: {"caption.duplicate", "caption.short"}, 5: {"caption.duplicate", "caption.long"}, 6: {"caption.duplicate", "caption.long"}}


def test_no_spread_means_no_finding(spark):
    items = spark.createDataFrame([(1, 50), (2, 50)], "item_id long, n_tokens long")
    assert rules.z_findings(items, "n_tokens", "length.high").count() == 0


def test_the_two_triage_policies_differ_on_a_lone_high_finding(spark):
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id long")
    f = spark.createDataFrame([(1, "a/v1", "x", "HIGH", 0.5), (2, "a/v1", "x.error", "LOW", 1.0), (3, "a/v1", "x", "LOW", 0.4), (9, "a/v1", "y", "LOW", 0.4)], "item_id long, analyzer string, category string, severity string, confidence double")
    per = triage.per_item(items, f)
    assert {r.item_id: r.bucket for r in triage.buckets(per).collect()} == {1: "PRIORITY_REVIEW", 2: "PRIORITY_REVIEW", 3: "NEEDS_REVIEW", 4: "READY_FOR_TRAINING", 9: "NEEDS_REVIEW"}
    assert {r.item_id: (r.outcome, r.priority) for r in triage.queue_outcomes(per).collect()}[1] == ("review_recommended", "medium")
    schemas.checked(f).count()
    with pytest.raises(Exception, match="out of range"):
        schemas.checked(f.withColumn("confidence", F.lit(2.0))).collect()


def test_multisets(spark):
    row = (1, "c", "a", "LOW")
    before, after = (spark.createDataFrame(x, "item_id long, category string, analyzer string, severity string") for x in ([row] * 3, [row] * 5))
    assert compare.new_findings(before, after).count() == 2 and compare.resolved_findings(before, after).count() == 0
    assert compare.unchanged(before, after).first().n == 3


def test_components_of_chains_stars_and_hot_nodes(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randint(1, 50)) for _ in range(80)] + [(300, 300), (301, None)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {v for k, v in got.items() if k >= 100} == {100}


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 1000).repartition(7)
    got = numbering.numbered(df, F.desc("v")).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [r.v for r in got] == list(range(999, -1, -1))


def test_flat_vectors_and_exact_pixels_pair_by_bounds(spark):
    v = [float(i % 8) / 10 for i in range(64)]
    rows = spark.createDataFrame([(1, v), (2, [x + 0.001 for x in v]), (3, [0.5] * 64), (4, [0.5] * 64), (5, v[::-1])], "vec_id long, embedding array<double>")
    assert [(r.first, r.second) for r in duplicates.near_pairs(rows).select("first", "second").collect()] == [(1, 2)]


def test_decision_scopes(spark):
    f = spark.createDataFrame([(1, "c", "a", "LOW"), (1, "d", "a", "LOW"), (2, "c", "b", "LOW")], "item_id long, category string, analyzer string, severity string")
    d = spark.createDataFrame([(1, None, None, "KEEP"), (1, "c", None, "UNDECIDED"), (1, "c", "a", "REMOVAL_CANDIDATE"), (2, "c", "a", "KEEP")], "item_id long, category string, analyzer string, decision string")
    got = {(r.item_id, r.category): (r.decision, r.scope) for r in decisions.applied(f, d).collect()}
    assert got == {(1, "c"): ("REMOVAL_CANDIDATE", 0), (1, "d"): ("KEEP", 2), (2, "c"): (None, None)}


def test_the_first_finding_takes_the_whole_items_decision(spark):
    found = spark.createDataFrame([(1, "a", "x", "LOW"), (1, "b", "x", "HIGH"), (2, "a", "x", "LOW"), (2, "b", "x", "LOW"), (3, "b", "y", "LOW"), (4, "a", "x", "LOW"), (4, "a", "y", "LOW")], "item_id long, category string, analyzer string, severity string")
    said = spark.createDataFrame([(1, None, None, "KEEP"), (1, "b", "x", "REMOVAL_CANDIDATE"), (2, "b", None, "KEEP"), (4, "a", "y", "KEEP"), (4, "a", None, "UNDECIDED")], "item_id long, category string, analyzer string, decision string")
    got = {r.item_id: r.decision for r in summaries.first_decided(found, said).collect()}
    assert got == {1: "KEEP", 2: "KEEP", 3: None, 4: "UNDECIDED"}


def test_confusion_of_nothing_and_readiness(spark):
    empty = spark.createDataFrame([], "predicted boolean, actual boolean")
    assert tuple(calibrate.confusion(empty).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    rows = spark.createDataFrame([(9, 0, 0, 9), (1, 0, 0, 1), (9, 4, 0, 9), (5, 0, 5, 9)], "tp long, fp long, fn long, tn long")
    assert [r.status for r in calibrate.readiness(calibrate.with_ratios(rows)).collect()] == ["ready", "insufficient_evidence", "false_positive_risk", "false_negative_risk"]


def test_policy_cascade_and_its_two_defaults(spark):
    row = ("ok", None, None, 2.0, 57.0, 10.0, 90.0, 90.0)
    df = spark.createDataFrame([row], "status string, exact_of long, probable_of long, megapixels double, artifact double, texture double, brightness_consistency double, contrast_score double")
    assert quality.policy(df).first().action == "CLEAN_MEDIUM" and quality.policy(df, {}).first().action == "CLEAN_LIGHT"
    # of margins, capped; of what is missing, only by rules; and of texture before artifacts
    told = lambda df, *rules: [(r.action, r.issue, r.confidence, r.explanation) for r in quality.policy(df, *rules).collect()]
    both = spark.createDataFrame([row, ("ok", None, None, None, 99.9, 10.0, 90.0, 90.0), ("error", 1, None, 2.0, 99.0, 0.0, 0.0, 0.0), ("ok", None, 7, 0.1, 0.0, 0.0, 90.0, 90.0), ("ok", None, None, 0.2, 0.0, 0.0, 90.0, 90.0)], df.schema)
    assert [x[:3] for x in told(both, {})] == [("CLEAN_LIGHT", "Mild artifact burden", 82), ("MANUAL_REVIEW", "Missing analysis evidence", 96), ("MANUAL_REVIEW", "Unreadable image", 99), ("DUPLICATE_REVIEW", "Probable duplicate", 90), ("REGENERATE", "Very low resolution", 74)]
    assert told(both)[1][:3] == ("CLEAN_STRONG", "High artifact burden", 97) and told(both, {})[3][3] == "Visual hash is similar to 7."
    textured = df.withColumns({"microtexture": F.lit(30.0), "highlight_speck": F.lit(28.0), "edge_sharpness": F.lit(0.0)})
    assert told(textured)[0] == ("TEXTURE_NORMALIZE_MEDIUM", "Elevated texture burden", 84, "Microtexture is near the dataset average (30.0 versus 30.0). Fine texture or bright specks justify moderate normalization.")


def test_zero_fill_and_capabilities(spark):
    f = spark.createDataFrame([("a/v1", "c", "LOW", 1)], "analyzer string, category string, severity string, item_id long")
    assert rollup.by_category_severity(f).count() == 5
    assert {r.name: r.n for r in rollup.coverage(f, ("a", "z")).collect()} == {"a": 1, "z": 0}
    ask, have = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"])], "r long, required array<string>"), spark.createDataFrame([("p", ["x"])], "p string, supported array<string>")
    assert [(r.r, r.p) for r in quality.capable(ask, have).collect()] == [(1, "p")]
    with pytest.raises(ValueError):
        rules.selected(f)
