"""Rows of documents that are told apart without relying on unique ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null doc_id where documents are ordered: after every other.
LAST_ID = (1 << 63) - 1


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key for a row of documents that also tells repeated or missing ids apart when their texts differ: id and MD5 of the text.

    Rows that agree in both columns share it; they are interchangeable for every operator here. It is never null.
    """
    number = F.coalesce(F.unhex(F.lpad(F.hex(F.col(doc_id).cast("long")), 16, "0")), F.lit(b""))
    return F.concat(number, F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"\0")))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as one struct "row", all other columns of docs, whose names then clash with nothing."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again, in their order."""
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in columns))
