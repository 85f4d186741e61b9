"""Substring deduplication against a log-structured index of window fingerprints.

The index holds, for every batch of documents that it has taken, an immutable run: the fingerprints of the batch's windows
(see anchors.py; an entry stands for the some 22 consecutive windows of WIDTH words that chose its anchor) in buckets by
anchor, each sorted. A new batch is dealt to the same buckets and merge-joined with the runs bucket by bucket; the runs
themselves are never shuffled again. Entries with equal spans are settled there; of them a run keeps one, that of the
document with the least id. Where spans share an anchor but differ, their windows are read from the texts again, once for
all batches of a load, and verified one by one. A window is a repeat if it also stands in a document with a smaller id.
When FAN_IN runs have gathered they are compacted into one, bucket by bucket.

An index that is given a path outlives its load: opened again there, it knows its runs and, beside them, the texts that
they came from, so the windows of earlier loads are verified like those of the batch. What an earlier load kept stays
kept; so loads, like batches, come by ascending ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.anchors import SPAN_KEY, Cut, Units, digest, find, halves, joined, meeting, remove, spans_of, texts_by_key
from curatrix.llm.arrow import batch_of
from curatrix.llm.kernels import union
from curatrix.sources.shared import Scratch, drop_path, new_path, table, whole_tables, write_buckets

WIDTH, GRAM, FAN_IN, BATCHES = 50, 8, 4, 5  # one batch more than FAN_IN: the last one meets a compacted run
SHARE = 4  # shuffle partitions to a bucket: entries are a small part of the texts that a partition is meant for, and every run has a file for each bucket
_HOW = Cut(True, WIDTH, GRAM)
_ENTRY = "anchor long, d0 long, d1 long, k binary, doc long, first int, n int"
_COLUMNS = [c.split()[0] for c in _ENTRY.split(", ")]


class FingerprintIndex:
    """Sorted immutable runs in a folder that all of the cluster sees, and the texts they came from if the folder is to be opened again.

    A run's folder is named run-(number)-(buckets)-(a name of its own) and registered as a table in the session's catalog,
    which is how Spark knows its buckets.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path, self.kept = spark, path or new_path(spark, "window-index"), path is not None
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(-(-parts // SHARE), min(parts, spark.sparkContext.defaultParallelism))
        self.runs, self.loads = whole_tables(spark, self.path, "run-"), whole_tables(spark, self.path, "texts-")
        for run in self.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(run)} ({_ENTRY}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, d0, d1) INTO {run.rsplit('-', 2)[1]} BUCKETS LOCATION '{run}'")

    def texts(self) -> DataFrame | None:
        """k, doc_id, text of all loads that are kept."""
        return self.spark.read.schema("k binary, doc_id long, text string").parquet(*self.loads) if self.loads else None

    def keep(self, texts: DataFrame) -> None:
        """Must come before the runs of these texts, so that no entry is ever without its text."""
        path = f"{self.path}/texts-{new_path(self.spark, '')[-32:]}"
        texts.selectExpr("k", "CAST(doc_id AS long) AS doc_id", "text").write.option("compression", "zstd").parquet(path)
        self.loads.append(path)

    def append(self, dealt: DataFrame) -> None:
        """Entries that stand in the index's buckets become a run; of those with equal spans the one of the least document."""
        path = f"{self.path}/run-{len(self.runs)}-{self.buckets}-{new_path(self.spark, '')[-12:]}"
        least = dealt.groupBy(*SPAN_KEY).agg(F.min(F.struct("doc", "k", "first", "n")).alias("at")).select(*SPAN_KEY, "at.*").select(*_COLUMNS)
        write_buckets(least, path, _name(path), self.buckets, *SPAN_KEY)
        self.runs.append(path)

    def entries(self) -> DataFrame | None:
        """All runs' entries, still in their buckets."""
        # all have windows; without a filter the union is one of column batches, which Spark believes to keep the buckets but doesn't
        return reduce(DataFrame.union, (self.spark.table(_name(p)).select(*_COLUMNS).filter("n > 0") for p in self.runs)) if self.runs else None

    def compact(self, fan_in: int = FAN_IN) -> None:
        """Merges all runs into one when there are `fan_in`. Old runs go only after the new one is whole."""
        if len(self.runs) < fan_in:
            return
        old = [*self.runs]
        self.append(self.entries())
        self.runs = self.runs[-1:]
        self._drop(old)

    def clear(self) -> None:
        """Deletes an index that isn't kept."""
        if not self.kept:
            self._drop(self.runs)
            self.runs = []

    def _drop(self, runs: list[str]) -> None:
        for path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
            drop_path(self.spark, path)


def _name(run: str) -> str:
    return f"curatrix_run_{run.rsplit('-', 1)[1]}"


@contextmanager
def _by_bucket(spark: SparkSession) -> Iterator[None]:
    """While in it, a join on more columns than the buckets' own doesn't deal the runs anew."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _windows(u: Units, at: int, x: dict) -> Iterator[tuple]:
    first = at + x["first"]
    parts = joined(u, first, first + x["n"] - 1 + WIDTH, _HOW)
    ends = np.cumsum([len(w) + 1 for w in parts.split()]).tolist()
    begins = [0, *ends]
    for i in range(x["n"]):
        yield digest(parts[begins[i] : ends[i + WIDTH - 1] - 1]), x["k"], x["doc"], x["first"] + i, x["old"]


def add_batch(index: FingerprintIndex, batch: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Takes a batch (doc_id, text) into the index. Returns what take() does; flags hold the repeats that find() is sure of too."""
    rows = scratch.keep(find(batch, _HOW, True), "anchors")
    whole, left = take(index, rows.filter("rep"), scratch)
    return whole.union(_flags(rows.filter("sure"))), left


def _flags(occurrences: DataFrame) -> DataFrame:
    return occurrences.selectExpr("k", "first AS s", f"first + n - 1 + {WIDTH} AS e")


def take(index: FingerprintIndex, entries: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Takes a batch's entries into the index. Returns its flags k, s, e, words s to e of the row with key k are repeats, and its
    occurrences whose windows are yet to be verified against all others with their anchors.

    The entries are dealt to the index's buckets, which is their only shuffle; all joins are bucket by bucket.
    """
    fresh = scratch.bucketed(entries.select(*_COLUMNS), "batch", *SPAN_KEY, buckets=index.buckets)
    old = index.entries()
    index.append(fresh)
    own = fresh.groupBy("anchor").agg(*halves(), F.min("doc").alias("near"), F.max("doc").alias("far"))
    same = fresh.groupBy(*SPAN_KEY).agg(F.min("doc").alias("least"))
    if old is not None:
        own = own.join(old.groupBy("anchor").agg(*halves()).toDF("anchor", "ol0", "om0", "ol1", "om1"), "anchor", "left")
        before = old.groupBy(*SPAN_KEY).agg(F.min("doc").alias("before"))
    else:
        own = own.selectExpr("*", *(f"CAST(NULL AS long) AS {c}" for c in ("ol0", "om0", "ol1", "om1")))
        before = same.withColumnRenamed("least", "before")
    met = own.filter("near < far OR ol0 IS NOT NULL").selectExpr("anchor", "least(l0, ol0) < greatest(m0, om0) OR least(l1, ol1) < greatest(m1, om1) AS other")
    with _by_bucket(index.spark):
        known = same.join(before, SPAN_KEY, "left").select(*SPAN_KEY, F.least("least", "before").alias("least"))
        settled = scratch.keep(fresh.join(met, "anchor").join(known, SPAN_KEY).withColumn("flag", F.expr("doc > least")), "settled")
    index.compact()
    return _flags(settled.filter("flag")), settled.filter("other AND NOT flag").selectExpr("k", "anchor", "doc", "first", "n")


def met_by(index: FingerprintIndex, left: DataFrame, scratch: Scratch) -> DataFrame:
    """The occurrences that batches have left, and the index's with the same anchors, which are old: all that left's windows may stand in.

    The index has by now the batches too, but of equal spans only one, so it doesn't replace what they have left.
    """
    with _by_bucket(index.spark):
        old = scratch.keep(index.entries().join(left.select("anchor").distinct(), "anchor", "left_semi").selectExpr("k", "anchor", "doc", "first", "n", "true AS old"), "old-anchors")
    return left.selectExpr("*", "false AS old").union(old)


def verified(texts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """Flags k, s, e of the windows of occurrences that aren't old, which also stand in an occurrence of a document with a smaller id."""
    # an occurrence may be a batch's own and met again by later ones
    once = wanted.groupBy("k", "anchor", "doc", "first", "n").agg(F.min("old").alias("old"))
    windows = scratch.keep(spans_of(texts, once, _HOW, _windows, "digest binary, k binary, doc long, s int, old boolean", [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]), "windows")
    found = meeting(windows, ["digest"], ["k", "s"], [F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("old").alias("all_old")], "least < most AND NOT all_old")
    return found.filter("doc > least AND NOT old").selectExpr("k", "s", f"s + {WIDTH} AS e")


def _finish(found) -> pa.RecordBatch:
    rows = []
    for doc_id, text, pairs in found:
        parts = text.split()
        drop = union(np.array([p["s"] for p in pairs], np.int64), np.array([p["e"] for p in pairs], np.int64), len(parts))
        kept = [w for w, d in zip(parts, drop.tolist(), strict=True) if not d] if pairs else parts
        rows.append((doc_id, len(parts), len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return batch_of(["doc_id", "n_words", "n_removed", "kept_sha256"], list(zip(*rows, strict=True)), [pa.int64()] * 3 + [pa.string()])


def deduplicate(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each of docs, taken into an index in batches of ascending doc_id.

    A null text has no words; texts of fewer than WIDTH words lose none; no documents give no rows. A null doc_id comes after
    all others, and no two such rows are before each other; neither are repeated rows of one id, so both keep what they share.
    Other columns of docs, whatever their names, are left out. A long text is taken whole, by one task, at some 100 bytes of
    memory for each of its words. What an index with a path holds of earlier loads comes before too if its ids are smaller;
    this load is then kept in it.
    """
    index = index or FingerprintIndex(docs.sparkSession)
    scratch, flags_only = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    texts = texts_by_key(docs, flags_only)
    before = index.texts()
    if index.kept:
        index.keep(texts)
    bounds = docs.select("doc_id").na.drop().approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    rows = scratch.keep(find(docs, _HOW, True), "anchors")
    flags, left = [_flags(rows.filter("sure"))], []
    for i in range(len(bounds) + 1):
        batch = rows.filter("rep")
        if i > 0:
            batch = batch.filter(F.col("doc") > bounds[i - 1])
        if i < len(bounds):
            batch = batch.filter(F.col("doc") <= bounds[i])
        whole, more = take(index, batch, scratch)
        flags.append(whole)
        left.append(more)
    known = texts if before is None else texts.union(before)
    flags.append(verified(known, met_by(index, reduce(DataFrame.union, left), scratch), scratch))
    # dealt anew, as each part of the union would write a small file for each of its tasks
    found = flags_only.keep(reduce(DataFrame.union, flags).repartition("k"), "flags")
    scratch.clear()
    index.clear()
    return remove(texts, found, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


#: For DuckDB. A window is compared as text, its words joined by a space, which no word has.
SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM w
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS window_text FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY window_text) AS least FROM g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE doc_id > least
), x AS (
  SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE [word FOR word, j IN words IF NOT list_contains(gone, j)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN x ON w.doc_id = x.doc_id
"""
