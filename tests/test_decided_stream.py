"""The stream of last decisions against the batch form: restarts, late and repeated events, scopes that are forgotten."""

import datetime as dt
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curatrix.operators import decisions
from curatrix.plans.base import decision_log
from curatrix.streaming import decided

DATA = "/root/testdata/sf0.001"
LOG = "item_id long, category string, analyzer string, decision string, ts timestamp, event_id long"


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "category", "analyzer", "decision", "event_id").collect()), key=str)


def feed(spark, folder, log, i):
    spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, files=1):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(folder)


@pytest.fixture(scope="module")
def log(spark):
    """The event log in batches: within each in any order, a third of it repeated later, some of it a batch late."""
    rng = random.Random(6)
    have = [tuple(r) for r in decision_log(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp")).select("item_id", "category", "analyzer", "decision", "ts", "event_id").orderBy("ts").collect()]
    parts = [have[i : i + 150] for i in range(0, len(have), 150)]
    for i, p in enumerate(parts):
        if i + 1 < len(parts):
            parts[i + 1] += rng.sample(p, len(p) // 3) + [p.pop(rng.randrange(len(p))) for _ in range(20)]
        rng.shuffle(p)
    return have, parts


def test_restarts_and_disorder_change_nothing(spark, tmp_path, log):
    have, parts = log
    folder, out, checkpoint = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    run = lambda: decided.follow(stream(spark, folder), out, checkpoint, late="60 days", keep="60 days").awaitTermination()
    for i, p in enumerate(parts):
        feed(spark, folder, p, i)
        if i == len(parts) // 2:
            run()
            # as if it was killed after the last batch's files were written and before it was committed
            last = max((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
            for f in (f"{checkpoint}/commits/{last}", f"{checkpoint}/commits/.{last}.crc"):
                Path(f).unlink(missing_ok=True)
    run()
    want = decisions.latest(spark.createDataFrame(have, LOG))
    assert rows(decided.current(spark, out)) == rows(want)
    # only changes are written, and those of the repeated batch once
    written = spark.read.schema(decided.CHANGES).parquet(out)
    assert written.count() == written.distinct().count() <= len(have)


def test_scopes_are_told_apart_and_late_events_dropped(spark, tmp_path):
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    first = [(1, None, None, "KEEP", day(5), 1), (1, "", None, "UNDECIDED", day(5), 2), (1, "c", None, "KEEP", day(5), 3), (1, "c", "a", "KEEP", day(5), 4), (None, "c", "a", "KEEP", day(5), 5), (2, None, None, "KEEP", None, 6), (3, "c", None, "KEEP", day(5), 9), (3, "c", None, "UNDECIDED", day(5), 8)]
    feed(spark, f"{tmp_path}/log", first, 0)
    run = lambda: decided.follow(stream(spark, f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", late="1 day", keep="3 days").awaitTermination()
    run()
    assert {r[:3]: r[3] for r in rows(decided.current(spark, f"{tmp_path}/out"))} == {(1, None, None): "KEEP", (1, "", None): "UNDECIDED", (1, "c", None): "KEEP", (1, "c", "a"): "KEEP", (3, "c", None): "KEEP"}
    feed(spark, f"{tmp_path}/log", [(9, None, None, "KEEP", day(20), 20)], 1)
    run()  # the watermark is now at the 19th: what was decided on the 5th is forgotten
    feed(spark, f"{tmp_path}/log", [(3, "c", None, "REMOVAL_CANDIDATE", day(6), 21), (1, "c", None, "REMOVAL_CANDIDATE", day(19, 12), 22), (9, None, None, "KEEP", day(20), 20)], 2)
    run()
    got = {r[:3]: r[3] for r in rows(decided.current(spark, f"{tmp_path}/out"))}
    assert got[3, "c", None] == "KEEP" and got[1, "c", None] == "REMOVAL_CANDIDATE"
    assert spark.read.schema(decided.CHANGES).parquet(f"{tmp_path}/out").filter("item_id = 9").count() == 1


def test_state_is_forgotten_by_timers():
    """The processor itself, with a handle and a map that stand for Spark's."""
    import pandas as pd

    class Map(dict):
        getValue, updateValue, removeKey, containsKey, iterator = dict.__getitem__, dict.__setitem__, dict.pop, dict.__contains__, dict.items

    class Handle:
        def __init__(self):
            self.timers, self.map = [], Map()

        def getMapState(self, *_):
            return self.map

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    handle, processor = Handle(), decided.LastDecisions(1000)
    processor.init(handle)
    frame = lambda *r: pd.DataFrame(r, columns=["category", "analyzer", "decision", "us", "event_id"])
    out = list(processor.handleInputRows((7,), iter([frame(("a", None, "X", 5_000_000, 1), ("a", None, "Y", 5_000_000, 2)), frame(("b", None, "Z", 9_000_000, 3))]), None))
    assert [tuple(r)[:4] for r in out[0].itertuples(index=False)] == [(7, "a", None, "Y"), (7, "b", None, "Z")] and handle.timers == [6000, 10_000]
    assert list(processor.handleInputRows((7,), iter([frame(("a", None, "X", 5_000_000, 1))]), None)) == []
    list(processor.handleExpiredTimer((7,), None, At(6000)))
    assert [k for (k,) in handle.map] == ["=b\x1f"]
