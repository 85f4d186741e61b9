"""Every query with SQL, against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest

from curatrix.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=str) == want


def test_entry_imports_without_a_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_prune(spark, capsys):
    QUERIES["metric_outliers_by_segment"](spark, DATA).explain("formatted")
    text = capsys.readouterr().out
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text and "PushedFilters" in text
    QUERIES["top_items"](spark, DATA).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
