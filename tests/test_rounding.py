"""Roundings near a half: sums whose last bit is off, and confidences in a report's text."""

from pyspark.sql import functions as F

from curatrix.operators import quality, reports


def test_a_sums_last_bit_does_not_decide_a_half(spark):
    # 87.23 * 0.25 + 92.04 * 0.15 + 0 * 0.20 + 28.83 * 0.15 + 85.51 * 0.10 + 65.04 * 0.15 is 58.245, in doubles 58.245000000000005
    row = dict(zip(quality.IMAGE_WEIGHTS, (87.23, 92.04, 0.0, 28.83, 85.51, 65.04), strict=True))
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    assert df.select(quality.weighted(quality.IMAGE_WEIGHTS).alias("q")).first().q == 58.24
    values = spark.createDataFrame([(58.245000000000005, 58.24), (58.2450001, 58.25), (58.235, 58.24), (0.125, 0.12), (-3.0, 0.0), (100.4, 100.0), (33.33, 33.33), (None, 100.0)], "v double, want double")
    assert all(r.got == r.want for r in values.select("want", quality.two(values.v).alias("got")).collect())


def test_confidences_are_told_as_their_doubles_round(spark):
    told = [k / 1000 for k in range(1001)] + [0.4150000001, 0.62125]
    df = spark.createDataFrame([(i, "a/v1", "c.d", "LOW", x) for i, x in enumerate(told)], "item_id long, analyzer string, category string, severity string, confidence double")
    lines = {r.item_id: r.line for r in reports.finding_lines(df, F.lit(0.35)).collect()}
    assert lines == {i: f"  [LOW] c.d — confidence {x:.2f} (FP rate ~35%)" for i, x in enumerate(told)}
