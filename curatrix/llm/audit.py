"""How filters interact: what each removes, alone and after others, in every order.

Words are exploded and aggregated twice, by (document, word) and by document, for totals and distincts. A document's words
stand in one row, so no group reaches beyond a piece of texts: both aggregations are Arrow's, inside the tasks, and no word
is shuffled. (Exploded in Spark SQL, the words of 0.5 GB of documents took 288 to 454 CPU seconds of a budget of 204.)

Flags of copies and labels are then outer-joined to the documents' numbers, rows that agree in all of them being counted
before each join, so that no id and no text is hot in one. One aggregation of 32 conditional counts a part, one for each set
of filters that a document fails, holds all there is to know: every order's steps are sums over them.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.kernels import SPACE, text_arrays, words
from curatrix.llm.rows import LAST_ID
from curatrix.sources.shared import materialize, table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _counts(piece: pa.RecordBatch) -> pa.RecordBatch:
    buf, at = text_arrays(piece.column(piece.schema.get_field_index("text")))
    start, end, before = words(buf, at, SPACE)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[~SPACE[buf]])])
    exploded = pa.table({"row": np.repeat(np.arange(piece.num_rows), np.diff(before)), "word": each.dictionary_encode().indices})
    by_word = exploded.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
    by_row = by_word.group_by("row", use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    out = np.zeros((2, piece.num_rows), np.int64)  # rows without words are in no group
    out[:, by_row["row"].to_numpy()] = by_row["count_all_sum"].to_numpy(), by_row["count_all"].to_numpy()
    return batch_of(["n_words", "n_distinct"], list(out), [pa.int64()] * 2)


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, n_words and n_distinct: the words of each text and how many different ones they are.

    A null text has none. A long text is taken whole, at some 60 bytes of memory for each of its words.
    """
    return map_texts(docs, _counts, "n_words long, n_distinct long", keep=keep)


def _bits(fails: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), start=F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit i: FILTERS[i] fails), good, toxic, n: how many documents agree in the four before.

    A null text is empty, a null source the part "". Texts are told apart by SHA-256. Of a text, the rows of the least doc_id are its first; a null doc_id
    is greater than any other and rows of one doc_id aren't smaller than each other. A document is good or toxic if any
    label of its doc_id says so; without one it is neither. Only doc_id, text and source of docs are read.
    """
    text = F.coalesce("text", F.lit(""))
    capitals, length = F.regexp_count(text, F.lit("[A-Z]")), F.length(text)
    each = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        (100 * capitals.cast("long") > CAPITAL_PERCENT * length).alias("c"), text.rlike("[#$%&*|]").alias("d"), text.alias("text"),
    )
    counted = word_counts(each, keep=["doc_id", "part", "digest", "c", "d"])
    text_fails = _bits([F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"), F.col("c"), F.col("d")])
    marked = materialize(counted.select("doc_id", "part", "digest", text_fails.alias("fails")), "flags")
    alike = marked.groupBy("digest", "doc_id", "part", "fails").count()
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # joined by text and id: a text's copies don't meet
    with_e = alike.join(first, ["digest", "doc_id"], "left").withColumn("fails", F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << 4))
    by_id = with_e.groupBy("doc_id", "part", "fails").agg(F.sum("count").alias("n"))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # the id that stands for null has no label
    known = by_id.join(said.filter(F.col("doc_id") < LAST_ID), "doc_id", "left")
    return known.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def fail_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for each set of filters, the documents that fail just these: fails_0 to fails_31, of them good_0 to good_31 and toxic_0 to toxic_31. A set's number has bit i for FILTERS[i]."""
    of = lambda name, also: [F.coalesce(F.sum(F.when((F.col("fails") == m) & also, F.col("n"))), F.lit(0)).alias(f"{name}_{m}") for m in range(SETS)]
    return flagged(docs, labels).groupBy("part").agg(*of("fails", F.lit(True)), *of("good", F.col("good")), *of("toxic", F.col("toxic")))


def steps(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the step's counts, from fail_counts: 120 orders of 5 steps for each part.

    Over all orders, a document that fails k filters is removed by each of them in 120 / k, so shapley is a sum as well.
    """
    row = counts.select("part", *(F.array(*(F.col(f"{name}_{m}") for m in range(SETS))).alias(name) for name in ("fails", "good", "toxic")))
    row = row.select("*", F.explode(F.array(*map(F.lit, _ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), start=F.lit(0))
    bit = sum((F.when(F.instr("filter_order", x) == F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), start=F.lit(0))
    row = row.withColumn("before", before).withColumn("bit", bit)
    over = lambda name, said, times="1": F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (s, m) -> s + IF({said}, {name}[m] * {times}, 0L))")
    here = "m & before = 0 AND m & bit <> 0"
    return row.select(
        "part", "filter_order", "step",
        over("fails", "m & (before | bit) = 0").alias("kept"), over("fails", here).alias("removed"), over("fails", "m & before <> 0 AND m & bit <> 0").alias("redundant"), F.col("fails")[F.col("bit")].alias("unique_fails"),
        over("good", here).alias("good_lost"), over("toxic", here).alias("toxic_lost"), over("fails", "m & bit <> 0", f"({len(_ORDERS)} div greatest(1, bit_count(m)))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """steps() of fail_counts(). No documents give no rows; an empty table of labels gives zeros; repeated rows count each."""
    return steps(fail_counts(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), f AS (
  SELECT t.part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    EXISTS (SELECT 1 FROM t AS u WHERE u.text = t.text AND u.doc_id < t.doc_id) AS e,
    EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM t
), l AS (
  SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS l(x)
), o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l AS p, l AS q, l AS r, l AS s, l AS u
  WHERE q.x <> p.x AND r.x NOT IN (p.x, q.x) AND s.x NOT IN (p.x, q.x, r.x) AND u.x NOT IN (p.x, q.x, r.x, s.x)
), g AS (
  SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM f
), h AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY ALL
), v AS (
  SELECT part, filter_order, failed, n, good, toxic, least(CASE WHEN instr(failed, 'A') > 0 THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN instr(failed, 'B') > 0 THEN instr(filter_order, 'B') ELSE 6 END, CASE WHEN instr(failed, 'C') > 0 THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN instr(failed, 'D') > 0 THEN instr(filter_order, 'D') ELSE 6 END, CASE WHEN instr(failed, 'E') > 0 THEN instr(filter_order, 'E') ELSE 6 END) AS place FROM h, o
), z AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, CAST(sum(CASE WHEN place > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN place = step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN place < step AND instr(failed, substr(filter_order, step, 1)) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = substr(filter_order, step, 1) THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN place = step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM v, unnest([1, 2, 3, 4, 5]) AS s(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM z
"""
