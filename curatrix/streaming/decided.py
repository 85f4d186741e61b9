"""The last decision of each scope, as state of a stream by item that survives restarts and forgets what is settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from curatrix.operators.decisions import SCOPE, latest

CHANGES = "item_id long, category string, analyzer string, decision string, ts timestamp, event_id long"
_SEP = "\x1f"


def _scope(category: str | None, analyzer: str | None) -> str:
    """A scope as one string; null is a scope of its own, apart from the empty string."""
    return _SEP.join("" if x is None else f"={x}" for x in (category, analyzer))


class LastDecisions(StatefulProcessor):
    """Keeps of an item's scopes the last decision each, emits those that change it, and forgets a scope `keep_ms` of event time after its last.

    A decision is later than another by (ts, event_id), so events may come in any order and more than once.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "scope string", "us long, event_id long, decision string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for batch in rows:
            # the last of each scope within the batch, before any state is read
            for c, a, d, us, e in zip(batch.category, batch.analyzer, batch.decision, batch.us, batch.event_id, strict=True):
                scope, this = _scope(c, a), (int(us), int(e), d, c, a)
                if scope not in best or best[scope][:2] < this[:2]:
                    best[scope] = this
        changed = []
        for scope, (us, event, decision, c, a) in best.items():
            held = self.last.getValue((scope,)) if self.last.containsKey((scope,)) else None
            if held is None or (held[0], held[1]) < (us, event):
                self.last.updateValue((scope,), (us, event, decision))
                self.handle.registerTimer(us // 1000 + self.keep_ms)
                changed.append((key[0], c, a, decision, pd.Timestamp(us, unit="us"), event))
        if changed:
            yield pd.DataFrame(changed, columns=["item_id", "category", "analyzer", "decision", "ts", "event_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        for (scope,), (us, _, _) in list(self.last.iterator()):
            if us // 1000 + self.keep_ms <= upto:
                self.last.removeKey((scope,))
        return iter(())


def changes(log: DataFrame, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """A stream of the decisions that changed what was the last of their scope, from one of (item_id, category, analyzer, decision, ts, event_id).

    Events later than the watermark by `late` are dropped by it, so a scope that is forgotten can't be overtaken by an
    older event; rows without an item, a time or an event_id are left out. Needs the state store that RocksDB backs.
    """
    rows = log.withWatermark("ts", late).filter("item_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withColumn("us", F.unix_micros("ts"))
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("item_id").transformWithStateInPandas(LastDecisions(ms), CHANGES, "Append", "EventTime")


def follow(log: DataFrame, table: str, checkpoint: str, late: str = "1 hour", keep: str = "30 days") -> StreamingQuery:
    """Appends changes to the table at a path and processes what is there; started again with the same checkpoint, it goes on where it was stopped."""
    conf, name = log.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query takes the settings of its start
        return changes(log, late, keep).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last decision of each scope, from what follow() has appended."""
    return latest(spark.read.schema(CHANGES).parquet(table)).select(*SCOPE, "decision", "ts", "event_id")
