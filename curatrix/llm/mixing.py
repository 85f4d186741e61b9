"""Mixing sources to target weights by weighted fair queueing.

A source is a flow whose documents wait in shuffled order, up to COPIES times over; a copy's virtual finish time is the
source's words up to and with it, divided by the source's target. Copies are taken in order of finish time until the
total budget is spent, so at any moment each source has had its share, and at the end its target to within a document.

No source and no point in time meets in one task: a shuffled source is cut by the hash that orders it, into more buckets
the more rows there are, and time into TIME_BUCKETS; their sums are what prefix sums run over. The bucket of time that the
budget ends in is range-partitioned once more, and only the range with the cut is put in order, TOGETHER copies or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.rows import packed, row_key, unpacked
from curatrix.sources.shared import materialize, table

WEIGHTS, COPIES = (5, 2, 1), 3
TIME_BUCKETS, TOGETHER = 8192, 50_000
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _digits(rows: int) -> int:
    """Hex digits of a hash that cut so many rows into buckets of TOGETHER or fewer, three at least."""
    digits = 3
    while rows > TOGETHER * 16**digits:
        digits += 1
    return digits


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """source, sid, source_size, target from sizes (source, source_size), a row for each source.

    Weighted shares of the sum of all sizes, none above copies * source_size: sources are sorted by the share at which
    they are full, and the first that its level doesn't fill sets the level of all after it.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("w", w)
    ranked = ranked.withColumn("cap", (F.lit(copies) * F.col("source_size")).cast("double")).withColumn("full", F.col("cap") / F.col("w"))
    order = Window.orderBy("full", "sid")
    every, before, after = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = ranked.withColumn("level", level)
    chosen = F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.struct("full", "sid"))).over(every)
    return leveled.withColumn("target", F.least("cap", chosen * F.col("w"))).select("source", "sid", "source_size", "target")


def _first_over(sums: DataFrame, place: str, before: int, budget: int) -> Row | None:
    """Of sums (place, n, of few rows) the first, in order, up to and with which more than the budget is spent, and how much (upto)."""
    upto = sums.withColumn("upto", F.sum("n").over(Window.orderBy(place)) + before)
    return upto.filter(F.col("upto") > budget).orderBy(place).first()


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """doc_id, k (the row's key), size, source_size, target, copies_taken, taken, one row for each of docs.

    A null text has size 0 (and is taken, without words, as long as its place comes before the cut); a null source is a
    source, the last; repeated rows queue one after another; equal orders are settled by doc_id and size. No documents give
    no rows; other columns, whatever their names, aren't read. Texts of any length are only counted.
    """
    spark = docs.sparkSession
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = materialize(docs.select("doc_id", _key().alias("k"), "source", word_count().alias("size"), h.alias("h")), "sizes")
    named = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, copies), "targets")
    total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    rows = rows.join(named, rows["source"].eqNullSafe(named["source"])).drop("source").withColumn("b", F.substring("h", 1, _digits(total.rows)))
    sums = rows.groupBy("sid", "b").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "b", (F.sum("n").over(Window.partitionBy("sid").orderBy("b")) - F.col("n")).alias("base"))
    within = Window.partitionBy("sid", "b").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("sum", F.sum("size").over(within)).join(base, ["sid", "b"]).withColumn("sum", F.col("sum") + F.col("base"))
    queued = materialize(queued.select("doc_id", "k", "size", "sid", "source_size", "target", "sum"), "queue")

    finish = F.expr(f"transform(sequence(0, {copies - 1}), c -> struct(CASE WHEN target > 0 THEN cast(c * source_size + sum AS double) / target ELSE double('infinity') END AS finish, sid AS sid, coalesce(doc_id, {-(1 << 63) + 1}L) AS doc_id, c AS c, size AS size))")
    at = queued.select(F.explode(finish).alias("at")).select("at", F.col("at.size").alias("n"), F.least(F.floor(F.col("at.finish") * TIME_BUCKETS), F.lit(2 * TIME_BUCKETS)).alias("t"))
    cut = _first_over(at.groupBy("t").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "t", 0, total["size"])  # of at most 2 * TIME_BUCKETS + 1 rows
    if cut is None:
        taken = F.lit(copies)
    else:
        inside, parts, before = at.filter(F.col("t") == cut.t), -(-cut.rows // TOGETHER), cut.upto - cut.n
        if parts > 1:
            inside = materialize(inside.repartitionByRange(parts, "at").withColumn("p", F.spark_partition_id()), "cut")
            part = _first_over(inside.groupBy("p").agg(F.sum("n").alias("n")), "p", before, total["size"])
            inside, before = inside.filter(F.col("p") == part.p), part.upto - part.n
        inside = inside.withColumn("upto", F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        first = inside.filter(F.col("upto") + before > total["size"]).agg(F.min("at").alias("at")).first()["at"]
        keep = F.struct(F.lit(first.finish).alias("finish"), F.lit(first.sid).cast("long").alias("sid"), F.lit(first.doc_id).cast("long").alias("doc_id"), F.lit(first.c).alias("c"), F.lit(first.size).cast("long").alias("size"))
        taken = F.size(F.filter(finish, lambda x: x < keep))
    return queued.withColumn("copies_taken", taken).select("doc_id", "k", "size", "source_size", "target", "copies_taken", (F.col("copies_taken") * F.col("size")).cast("long").alias("taken"))


def _key() -> Column:
    """Rows that share it agree in id, text and source, so they stand for each other."""
    return F.concat(row_key(), F.coalesce(F.col("source").cast("binary"), F.lit(b"\xff")))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs in the mix, each as often as it is taken, in docs' own columns."""
    plan = schedule(docs).filter("copies_taken > 0")
    # of rows with one key, one is taken as often as all are
    once = plan.groupBy("k").agg(F.sum("copies_taken").cast("int").alias("copies_taken"))
    rows = packed(docs).withColumn("source", F.col("row.source")).withColumn("k", _key()).drop("source")
    taken = rows.dropDuplicates(["k"]).join(once, "k").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies_taken"))))
    return unpacked(taken, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents")).drop("k", "copies_taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(sid - 1) % 3 + 1] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, cap / w AS lim, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, sid, source_size, least(cap, w * (SELECT level FROM l WHERE level <= lim ORDER BY lim, sid LIMIT 1)) AS target FROM l
), q AS (
  SELECT doc_id, size, sid, source_size, target, sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(k * source_size + upto AS DOUBLE) / target AS finish, k FROM q, unnest([0, 1, 2]) AS u(k)
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, sid, doc_id, k ROWS UNBOUNDED PRECEDING) AS spent FROM c
)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) FILTER (spent <= (SELECT sum(size) FROM d)), 0) AS BIGINT) AS taken
FROM g GROUP BY doc_id, size, source_size, target
"""
