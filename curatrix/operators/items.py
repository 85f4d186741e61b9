"""Records and what is measured on each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantics import strip, token_count


def measured(records: DataFrame, item_id: str = "doc_id", text: str = "text", group: str = "source") -> DataFrame:
    """item_id, grp, text (stripped), n_chars, n_tokens, sha: one narrow row for each record, without a shuffle."""
    rows = records.select(F.col(item_id).alias("item_id"), F.col(group).alias("grp"), strip(text).alias("text"))
    return rows.select("item_id", "grp", "text", F.length("text").cast("long").alias("n_chars"), token_count("text").alias("n_tokens"), F.sha2("text", 256).alias("sha"))
