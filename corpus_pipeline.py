"""From raw documents to token files: five stages, each over all that the one before it kept.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, no rows at all, and further
columns whatever their names, which go with their rows; what becomes of such rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import decontaminate, mixing, simhash, tokens, toxicity
from curatrix.llm.rows import packed, unpacked
from curatrix.sources.shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic. Null and empty texts score as such texts do and stay unless that is toxic."""
    scored = toxicity.score(packed(docs), table(spark, sf_dir, "labels"), keep=["doc_id", "text", "row"])
    return unpacked(scored.filter("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies. Texts without words are copies of each other; a row without an id stays only if its group has no id."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 5 % of their words in benchmark passages. Texts without words stay; an empty benchmark takes nothing."""
    found = decontaminate.flagged(packed(docs), table(spark, sf_dir, "benchmark"), keep=["doc_id", "text", "row"])
    return unpacked(found.filter("NOT contaminated"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one of its own; texts without words cost nothing and stay while the budget lasts."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and from them the place, number and checksum of each document's ids. A null text has the end id alone."""
    return tokens.read(spark, tokens.write(docs, tokens.word_bpe())[0])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't fit the toxicity model; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None
