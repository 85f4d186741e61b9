"""Running a function over the texts of documents, piece by piece, inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from curatrix.llm.kernels import PIECE, pieces


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", keep: Sequence[str] = (), most: int = PIECE) -> DataFrame:
    """df.mapInArrow with fn applied to pieces of about `most` bytes of text. fn's columns are those of schema.

    keep: columns of df that stand before fn's; fn must then return one row for each that it gets, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, most):
                out = fn(piece)
                if out is None or not out.num_rows:
                    continue
                if keep:
                    columns = [piece.column(piece.schema.get_field_index(k)) for k in keep]
                    out = pa.RecordBatch.from_arrays([*columns, *out.columns], names=[*keep, *out.schema.names])
                yield out

    if not keep:
        return df.mapInArrow(run, schema)
    return df.mapInArrow(run, StructType([*(df.schema[k] for k in keep), *StructType.fromDDL(schema)]))


def batch_of(names: Sequence[str], columns: Sequence, types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))
