"""Joins of rows that are generated or exploded: Spark takes them for small, and they must not be broadcast."""

import random

import pytest

from curatrix.operators import filters, grids, summaries
from curatrix.plans.registry import QUERIES
from tests.conftest import DATA


@pytest.fixture
def written_plans(spark, monkeypatch):
    """The plans of all tables that a query writes meanwhile, by the table's name."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **how):
        plans.append((path.rsplit("/", 1)[1].rsplit("-", 1)[0], self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *args, **how)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return plans


def test_keys_of_codes_are_not_broadcast(spark, written_plans):
    QUERIES["closest_prior"](spark, DATA)
    searched = [p for name, p in written_plans if name.startswith(("same-code", "within-"))]
    assert len(searched) == 4 and not any("BroadcastHashJoin" in p for p in searched)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outliers_are_found_without_joining_cells(spark):
    plan = plan_of(QUERIES["grid_robust_outliers"](spark, DATA))
    assert "Join" not in plan and plan.count("Exchange") == 1  # of ids, before their cells are made


def test_a_blur_is_held_against_its_picture_without_a_join(spark):
    plan = plan_of(QUERIES["grid_preservation"](spark, DATA))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_preservation_of_pictures_that_lost_and_got_pixels(spark):
    rng = random.Random(3)
    before = {(i, y, x): rng.randrange(256) for i in range(4) for y in range(6) for x in range(5)}
    after = {(i, y + (i == 1), x): min(255, v + rng.randrange(40)) for (i, y, x), v in before.items() if i < 2} | {(i, 9, 9): 7 for i in (3, 5)}
    rows = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "id long, y long, x long, v int")
    got = {r.id: (r.pixel_difference, r.histogram_difference) for r in summaries.preservation(rows(before), rows(after)).collect()}
    assert set(got) == {0, 1}  # those with a pixel in common
    for i in got:
        apart = [abs(v - after[k]) for k, v in before.items() if k[0] == i and k in after]
        a, b = ([v // 4 for k, v in d.items() if k[0] == i] for d in (before, after))
        s = sum((a.count(n) * b.count(n)) ** 0.5 for n in set(a))
        assert got[i] == pytest.approx((sum(apart) / len(apart), max(0, 1 - s / (len(a) * len(b)) ** 0.5) ** 0.5), abs=1e-6)


def test_tiles_shades_are_not_broadcast(spark):
    plan = plan_of(QUERIES["filter_contrast"](spark, DATA))
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan


def test_lines_are_swept_without_joins(spark, written_plans):
    df = QUERIES["filter_edge_preserving"](spark, DATA)
    assert [name for name, _ in written_plans] == ["distances", "smoothed", "smoothed", "smoothed"]
    assert not any("Join" in p for p in [plan_of(df), *(p for _, p in written_plans)])


def test_pixels_and_edges_are_not_broadcast(spark, written_plans):
    df = QUERIES["filter_preservation"](spark, DATA)
    assert [p for name, p in written_plans if name == "both"] and not any("BroadcastHashJoin" in p for name, p in written_plans if name != "edges")
    assert plan_of(filters.edges(filters_images(spark))).count("BroadcastHashJoin") == 0
    assert df.count() == spark.read.parquet(f"{DATA}/supplier.parquet").count()


def filters_images(spark):
    v = "cast((id + y + x) % 256 AS int)"
    cells = grids.grid(spark.range(3), 8, 8, v)
    return cells.selectExpr("id", "y", "x", "8 AS width", "8 AS height", "v AS r", "v AS g", "v AS b")
