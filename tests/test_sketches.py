"""Baselines that are merged: halves against the whole, percentiles against exact places, batches that come twice."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import sketches
from curatrix.sources import shared


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, rng.gauss(0, 1), rng.lognormvariate(0, 9), -rng.lognormvariate(0, 3), 1e-300, -1e100, 5.0]) for _ in range(3000)]
    table = [(i, rng.choice(["a", "b", None]), v, float(i)) for i, v in enumerate(values)]
    table += [(3000, "a", None, 1.0), (3001, "b", math.nan, None), (3002, "c", None, math.inf), (3003, "a", -math.inf, 0.0)]
    return spark.createDataFrame(table, "id long, g string, x double, y double").repartition(5).cache()


def told(states, by=("g",)):
    found = sketches.finish(states, {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}, by)
    return {(*(r[b] for b in by), r["measure"]): r for r in found.collect()}


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9))


def test_states_of_parts_merge_to_that_of_the_whole(rows):
    whole = told(sketches.state(rows, ["x", "y"], ["g"]))
    parts = [sketches.state(rows.filter(F.col("id") % 4 == i), ["x", "y"], ["g"]) for i in range(4)]
    merged = parts[0].unionByName(parts[1])
    merged = sketches.merge(sketches.merge(merged, ["g"]).unionByName(parts[2].unionByName(parts[3])), ["g"])
    got = told(merged)
    assert set(got) == set(whole) and len(whole) == 8
    for k, w in whole.items():
        assert all(got[k][c] == w[c] for c in ("n", "errors", "least", "most", "p10", "p50", "p90", "p100"))
        assert close(got[k]["mean"], w["mean"]) and close(got[k]["stddev"], w["stddev"])


def test_percentiles_are_within_the_stated_share_of_exact_places(rows):
    table = rows.collect()
    for (g, m), r in told(sketches.state(rows, ["x", "y"], ["g"])).items():
        have = [v[m] for v in table if v["g"] == g]
        good = sorted(v for v in have if v is not None and math.isfinite(v))
        assert (r["n"], r["errors"]) == (len(good), len(have) - len(good))
        if not good:
            assert r["mean"] is r["p50"] is r["stddev"] is r["least"] is None
            continue
        assert (r["least"], r["most"]) == (good[0], good[-1])
        for name, p in {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}.items():
            exact = good[min(math.floor(len(good) * p), len(good) - 1)]
            assert abs(r[name] - exact) <= sketches.ALPHA * abs(exact) * (1 + 1e-9)
    one = told(sketches.state(rows.filter("abs(x) < 1e6 OR x IS NULL"), ["x"]), ())["x",]
    small = np.array([v["x"] for v in table if v["x"] is not None and abs(v["x"]) < 1e6])
    assert one["mean"] == pytest.approx(small.mean()) and one["stddev"] == pytest.approx(small.std())


def test_spread_far_from_zero(spark):
    v = [1e9 + i % 7 for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    halves = sketches.state(df.filter("x % 2 = 0"), ["x"]).unionByName(sketches.state(df.filter("x % 2 <> 0"), ["x"]))
    assert told(sketches.merge(halves), ())["x",]["stddev"] == pytest.approx(np.std(v), rel=1e-6)


def test_a_kept_baseline_takes_each_batch_once(spark, rows, tmp_path):
    path = f"file://{tmp_path}/b"
    batch = lambda i: rows.filter(F.col("id") % 5 == i)
    with pytest.raises(ValueError):
        sketches.load(spark, path, ["g"])
    for i in (0, 1, 0):
        sketches.update(spark, path, str(i), batch(i), ["x"], ["g"])
    # a batch that was cut short isn't whole
    sketches.state(batch(2), ["x"], ["g"]).write.parquet(f"{path}/batch-2/state")
    seen = lambda: sum(r.n + r.errors for r in sketches.load(spark, path, ["g"]).collect())
    n = {i: batch(i).count() for i in range(5)}
    assert seen() == n[0] + n[1]
    sketches.update(spark, path, "2", batch(2), ["x"], ["g"])
    sketches.compact(spark, path, ["g"])
    assert seen() == n[0] + n[1] + n[2] and [p.rsplit("/", 1)[1] for p in shared.listed(spark, path)] == ["merged-1"]
    sketches.update(spark, path, "1", batch(1), ["x"], ["g"])
    sketches.update(spark, path, "3", batch(3), ["x"], ["g"])
    # a merger that was cut short before it deleted what it covers counts nothing twice
    kept, shared_drop = [], sketches.drop_path
    sketches.drop_path = lambda s, p: kept.append(p)
    try:
        sketches.compact(spark, path, ["g"])
    finally:
        sketches.drop_path = shared_drop
    assert len(kept) == 2 and seen() == sum(n[i] for i in range(4))
    sketches.update(spark, path, "4", batch(4), ["x"], ["g"])
    sketches.compact(spark, path, ["g"])
    assert [p.rsplit("/", 1)[1] for p in shared.listed(spark, path)] == ["merged-3"]
    whole = told(sketches.state(rows, ["x"], ["g"]))
    for k, r in told(sketches.load(spark, path, ["g"])).items():
        assert all(close(r[c], whole[k][c]) for c in ("n", "errors", "mean", "stddev", "least", "most", "p10", "p50", "p90"))
