"""Measuring what comes into a folder, once each content, however often the run is stopped and started."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from curatrix.sources import ledger


def measure_new(source: DataFrame, path: str, checkpoint: str, measure: Callable[[DataFrame], DataFrame], item: str, content: str, writer: str = "writer", versions: tuple[str, ...] = ("1",)) -> StreamingQuery:
    """Adds all that a file source has and the ledger at path hasn't, batch by batch, and stops.

    The checkpoint knows which files were taken and the ledger which batches are whole: a batch that was cut short before
    either knew is done again under its number, and one that only the ledger knew is passed over. Each checkpoint needs a
    writer's name of its own; names and batches are compared as strings, so numbers are padded.
    """

    def each(batch: DataFrame, number: int) -> None:
        ledger.add(batch, path, f"{writer}-{number:012d}", measure, item, content, versions)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
