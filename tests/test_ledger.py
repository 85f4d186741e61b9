"""Measuring by content: killed and resumed runs, copies, versions and two writers."""

import os

import pytest
from pyspark.sql import functions as F

from curatrix.sources import ledger
from curatrix.streaming import incremental

ROWS = "item string, content string"


class Killed(Exception):
    pass


@pytest.fixture
def counted():
    """A measure that counts what it is given, and fails where it is told to."""
    calls = []

    def measure(df):
        calls.append(sorted(r.content or "" for r in df.select("content").collect()))
        if measure.fails and "bad" in calls[-1]:
            raise Killed
        return df.select("key", F.length(F.coalesce("content", F.lit(""))).alias("n"))

    measure.calls, measure.fails = calls, False
    return measure


def told(spark, path):
    return {r.item: r.n for r in ledger.measured(spark, path).collect()}


def test_each_content_is_measured_once(spark, tmp_path, counted):
    path = f"file://{tmp_path}/ledger"
    assert ledger.measured(spark, path) is None
    add = lambda rows, batch, **k: ledger.add(spark.createDataFrame(rows, ROWS), path, batch, counted, "item", "content", **k)
    assert add([("a", "x"), ("b", "x"), ("c", "yy"), ("c", "yy"), ("n", None), ("e", ""), (None, "zzz")], "w-0")
    assert counted.calls == [["", "", "x", "yy"]] and told(spark, path) == {"a": 1, "b": 1, "c": 2, "n": 0, "e": 0}
    assert not add([("z", "never")], "w-0")
    assert add([("d", "x"), ("a", "new"), ("f", "yy")], "w-1") and counted.calls[1] == ["new"]
    assert told(spark, path) == {"a": 3, "b": 1, "c": 2, "d": 1, "e": 0, "f": 2, "n": 0}
    assert add([("g", "x")], "w-2") and counted.calls[2] == []
    assert add([("g", "x")], "w-3", versions=("2",)) and counted.calls[3] == ["x"]
    assert ledger.measurements(spark, path).count() == 6


def test_two_writers_of_one_content_count_as_one(spark, tmp_path, counted, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([("a", "x"), ("b", "yy")], ROWS)
    real = ledger.touch
    # the first hasn't ended when the second begins, so each measures all of it
    late = []
    monkeypatch.setattr(ledger, "touch", lambda s, p: late.append(p))
    ledger.add(one, path, "one-0", counted, "item", "content")
    assert ledger.measured(spark, path) is None
    monkeypatch.setattr(ledger, "touch", real)
    ledger.add(one.withColumn("item", F.concat("item", F.lit("2"))), path, "two-0", counted, "item", "content")
    ledger.touch(spark, late[0])
    assert counted.calls == [["x", "yy"]] * 2 and ledger.measurements(spark, path).count() == 2
    assert told(spark, path) == {"a": 1, "b": 2, "a2": 1, "b2": 2}


def test_a_killed_stream_neither_skips_nor_measures_twice(spark, tmp_path, counted):
    folder, path, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "ledger", "checkpoint"))
    for i, rows in enumerate([[("a", "x"), ("b", "yy")], [("c", "bad"), ("d", "x")], [("e", "yy"), ("f", "last")]]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)

    def run():
        source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = incremental.measure_new(source, path, checkpoint, counted, "item", "content")
        query.awaitTermination()

    counted.fails = True
    with pytest.raises(Exception, match="Killed"):
        run()
    first = set(told(spark, path))
    assert "c" not in first and len(first) < 6
    counted.fails = False
    run()
    assert told(spark, path) == {"a": 1, "b": 2, "c": 3, "d": 1, "e": 2, "f": 4}
    killed = next(call for call in counted.calls if "bad" in call)
    done = [x for call in counted.calls for x in call]
    assert all(done.count(x) == 1 + (x in killed) for x in ("bad", "last", "x", "yy"))
    before = len(counted.calls)
    run()
    assert len(counted.calls) == before
    # killed between the ledger's last file and the checkpoint's: the batch is passed over
    last = max((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert len(counted.calls) == before and told(spark, path)["f"] == 4
