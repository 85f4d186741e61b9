"""Substring deduplication with an enhanced suffix array and its common-prefix interval tree.

The corpus's suffixes are sampled at anchors (see anchors.py), so that each window of WIDTH bytes that may repeat has one.
Suffixes that may share a window are brought together by what such a window must contain: the anchor with enough bytes
after it, or with enough before it. In such a bucket the suffixes are sorted, the common prefixes of neighbours taken, and
a stack scan visits the tree of their intervals from the leaves. An interval's occurrences are kept in the order of what
stands before them; a parent merges its children's lists small to large. Where a merge puts left contexts of different
children beside each other, their common part is a repeat that can't be extended to the right for all; as it ends where
they differ it can't be extended to the left for all either: it is maximal, and all that share it are its occurrences.

Exact copies of a whole span don't come to a bucket more than once, however many there are, so a bucket holds only
different contexts that share over half a window. A bucket is gathered in one task, so those of an anchor with more than
HOT occurrences (a passage that very many documents hold between different neighbours) aren't made: the windows of such
occurrences are counted instead, which no task has to gather.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.anchors import SPAN_KEY, Cut, Units, digest, find, meeting, remove, spans_of, texts_by_key
from curatrix.llm.arrow import batch_of
from curatrix.llm.kernels import runs, union
from curatrix.sources.shared import Scratch, table

WIDTH, GRAM = 200, 32
#: The most occurrences of an anchor whose different contexts are gathered in one task.
HOT = 2048
_HOW = Cut(False, WIDTH, GRAM)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:  # a[:low] agrees, a[:high] doesn't
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (first, last + 1, length) of a sorted list whose neighbours share common[i] with i - 1."""
    stack: list[tuple[int, int]] = []  # length, first
    for i in range(1, len(common) + 1):
        here = common[i] if i < len(common) else -1
        first = i - 1
        while stack and stack[-1][0] > here:
            length, first = stack.pop()
            yield first, i, length
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, first))


class _Merged:
    """Occurrences in the order of their left contexts, merged up the interval tree."""

    def __init__(self, left: list[bytes], right: list[bytes]) -> None:
        self.left = left
        self.by_left = sorted(range(len(left)), key=left.__getitem__)
        self.rank = [0] * len(left)
        for r, m in enumerate(self.by_left):
            self.rank[m] = r
        self.by_right = sorted(range(len(right)), key=right.__getitem__)
        self.common = [0, *(_common(right[a], right[b]) for a, b in zip(self.by_right, self.by_right[1:], strict=False))]

    def shared(self, a: int, b: int) -> int:
        """How far the left contexts of two ranks agree."""
        return _common(self.left[self.by_left[a]], self.left[self.by_left[b]])

    def merges(self) -> Iterator[tuple[int, list[int], list[list[int]]]]:
        """Of each interval, children first: its length, its largest child's ranks in order, and the other children's.

        The caller adds the others to the first, which then is the interval's own list.
        """
        parts: list[tuple[int, list[int]]] = []  # where a child begins, and its ranks
        at = 0
        for first, last, length in intervals(self.common):
            while at < last:
                parts.append((at, [self.rank[self.by_right[at]]]))
                at += 1
            children = []
            while parts and parts[-1][0] >= first:
                children.append(parts.pop()[1])
            children.sort(key=len, reverse=True)
            yield length, children[0], children[1:]
            parts.append((first, children[0]))


def reaches(left: list[bytes], right: list[bytes], width: int) -> Iterator[tuple[int, int, int]]:
    """Occurrence, and how far (before, after) maximal repeats of `width` units or more reach around it.

    left: what stands before each occurrence, reversed; right: what stands from it on. Each pair is the furthest to the left
    for its reach to the right; together they cover all that repeats. An occurrence is merged about log(n) times.
    """
    tree = _Merged(left, right)
    best = [-1] * len(left)
    for length, ranks, others in tree.merges():
        for r in (r for child in others for r in child):
            i = bisect_left(ranks, r)
            for near in ranks[max(0, i - 1) : i + 1]:
                before = tree.shared(r, near)
                for x in (r, near):
                    if before > best[x]:
                        best[x] = before
                        if before + length >= width:
                            yield tree.by_left[x], before, length
            ranks.insert(i, r)


def maximal_repeats(left: list[bytes], right: list[bytes], width: int) -> Iterator[tuple[int, int, list[int]]]:
    """All maximal repeats of `width` units or more, each once: before, after, and all its occurrences in order.

    A repeat is maximal if neither what stands before it nor what stands after it is the same for all its occurrences.
    """
    tree = _Merged(left, right)
    for length, ranks, others in tree.merges():
        child = {r: c for c, other in enumerate(others) for r in other}  # those of the largest child aren't in it
        for r in child:
            insort(ranks, r)
        seen = set()
        for r in child:
            low = high = bisect_left(ranks, r)
            while True:
                before = max(tree.shared(ranks[low - 1], ranks[low]) if low else -1, tree.shared(ranks[high], ranks[high + 1]) if high + 1 < len(ranks) else -1)
                if before < 0 or before + length < width:
                    break
                while low and tree.shared(ranks[low - 1], ranks[low]) >= before:
                    low -= 1
                while high + 1 < len(ranks) and tree.shared(ranks[high], ranks[high + 1]) >= before:
                    high += 1
                if (low, high) not in seen:
                    seen.add((low, high))
                    if len({child.get(x, -1) for x in ranks[low : high + 1]}) > 1:
                        yield before, length, sorted(tree.by_left[x] for x in ranks[low : high + 1])


def _contexts(u: Units, at: int, x: dict) -> Iterator[tuple]:
    """The occurrence's bytes before its anchor, reversed, and from it on, under each of its buckets."""
    first = at + x["first"]
    anchor = first + x["off"]
    left, right = u.data[first:anchor][::-1], u.data[anchor : first + x["n"] - 1 + WIDTH]
    half = (WIDTH - GRAM) // 2
    place = x["first"] + x["off"]
    if len(right) >= WIDTH - half:
        yield xxhash.xxh3_64_intdigest(right[: WIDTH - half]) - (1 << 63), x["k"], place, left, right
    if len(left) > half:
        yield xxhash.xxh3_64_intdigest(right[:GRAM] + left[: half + 1], seed=1) - (1 << 63), x["k"], place, left, right


def _windows(u: Units, at: int, x: dict) -> Iterator[tuple]:
    for i in range(x["first"], x["first"] + x["n"]):
        yield digest(u.data[at + i : at + i + WIDTH]), x["k"], i


def _per_bucket(contexts: DataFrame, of, schema: str, types: list[pa.DataType]) -> DataFrame:
    """The rows that `of` gives for each bucket's contexts (k, place, left, right), which it gets as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        bucket, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if len(rows) > 1:
                        out += of(bucket, *zip(*rows, strict=True))
                    bucket, rows = b, []
                rows.append(tuple(row))
            if out:
                yield batch_of(names, list(zip(*out, strict=True)), types)
        if len(rows) > 1 and (out := [*of(bucket, *zip(*rows, strict=True))]):
            yield batch_of(names, list(zip(*out, strict=True)), types)

    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _repeats(contexts: DataFrame) -> DataFrame:
    """k, s, e: the bytes of each context that are in a repeated window."""

    def of(_, k, place, left, right) -> Iterator[tuple]:
        return ((k[m], place[m] - before, place[m] + after) for m, before, after in reaches(left, right, WIDTH))

    return _per_bucket(contexts, of, "k binary, s int, e int", [pa.binary(), pa.int32(), pa.int32()])


def _groups(contexts: DataFrame) -> DataFrame:
    """repeat (a digest of its bytes), k, start, length of each occurrence of each maximal repeat among contexts."""

    def of(_, k, place, left, right) -> Iterator[tuple]:
        for before, after, members in maximal_repeats(left, right, WIDTH):
            name = digest(left[members[0]][:before][::-1] + right[members[0]][:after])
            for m in members:
                yield name, k[m], place[m] - before, before + after

    return _per_bucket(contexts, of, "repeat binary, k binary, start int, length int", [pa.binary(), pa.binary(), pa.int32(), pa.int32()]).distinct()


def shared_anchors(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of find's rows, those whose anchor occurs again (SPAN_KEY, k, first, n, off, sure, met, other) and, where its spans
    differ (other), one row for each different span (SPAN_KEY, k, first, n, off, met, flag: the span stands twice).

    met: the anchor's occurrences, equal ones of one batch counted once.
    """
    stands = rows.filter("rep").select(*SPAN_KEY, "k", "first", "n", "off", "sure")
    totals = [F.count("*").alias("met"), F.expr("min(d0) < max(d0) OR min(d1) < max(d1)").alias("other"), F.max("sure").alias("again")]
    seen = scratch.keep(meeting(stands, ["anchor"], ["k", "first"], totals, "met > 1 OR again").drop("again"), "shared-anchors")
    alike = seen.filter("other").groupBy(*SPAN_KEY).agg(F.min(F.struct("k", "first", "n", "off", "met")).alias("at"), F.expr("count(*) > 1 OR max(sure)").alias("flag"))
    return seen, scratch.keep(alike.select(*SPAN_KEY, "at.*", "flag"), "different-spans")


def compared(texts: DataFrame, spans: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Different spans that share an anchor: contexts by bucket, at most `hot` of an anchor, and the windows of all others."""
    few, many = spans.filter(F.col("met") <= hot), spans.filter(F.col("met") > hot)
    contexts = spans_of(texts, few.select("k", "first", "n", "off"), _HOW, _contexts, "bucket long, k binary, place int, left binary, right binary", [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()])
    windows = spans_of(texts, many.select("k", "first", "n"), _HOW, _windows, "digest binary, k binary, s int", [pa.binary(), pa.binary(), pa.int32()])
    return contexts, windows


def repeated(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs' texts by key, and flags k, s, e: the bytes s to e of the row with key k are in windows that stand elsewhere too."""
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = scratch.keep(find(docs, _HOW, False), "anchors")
    seen, spans = shared_anchors(rows, scratch)
    texts = texts_by_key(docs)
    contexts, windows = compared(texts, spans, hot)
    windows = scratch.keep(windows, "windows")
    twice = seen.filter("other").join(spans.filter("flag").select(*SPAN_KEY), SPAN_KEY, "left_semi")
    whole = rows.filter("sure").select("k", "first", "n").union(seen.filter("NOT other").select("k", "first", "n")).union(twice.select("k", "first", "n"))
    counted = meeting(windows, ["digest"], ["k", "s"], [F.count("*").alias("times")], "times > 1").selectExpr("k", "s", f"s + {WIDTH} AS e")
    flags = whole.select("k", F.col("first").alias("s"), F.expr(f"first + n - 1 + {WIDTH}").alias("e")).union(_repeats(contexts)).union(counted)
    found = kept.keep(flags, "flags")
    scratch.clear()
    return texts, found


def repeat_groups(docs: DataFrame) -> DataFrame:
    """repeat, doc_id, start, length: all occurrences of each maximal repeat of WIDTH bytes or more around each anchor.

    A repeat is named by a digest of its bytes; start counts bytes. It reaches as far as the windows that chose its anchor;
    a longer passage is the union of those of its anchors. Equal spans have all their occurrences; an anchor's occurrences
    are compared in one task, for which this report, unlike deduplicate, has no bound.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(find(docs, _HOW, False), "anchors")
    _, spans = shared_anchors(rows.withColumn("rep", F.lit(True)), scratch)
    texts = texts_by_key(docs, scratch)
    found = _groups(compared(texts, spans, 1 << 62)[0])
    # a context's occurrences elsewhere, whole spans that stand twice among them
    place = rows.select(*SPAN_KEY, F.col("k").alias("k2"), F.col("first").alias("first2"))
    span = spans.select(*SPAN_KEY, "k", "first", "n")
    every = found.join(span, "k").filter(f"start >= first AND start + length <= first + n - 1 + {WIDTH}").join(place, SPAN_KEY)
    inside = every.selectExpr("repeat", "k2 AS k", "start - first + first2 AS start", "length")
    twice = rows.groupBy(*SPAN_KEY).agg(F.count("*").alias("times")).filter("times > 1").select(*SPAN_KEY)
    alone = rows.join(twice, SPAN_KEY).selectExpr("unhex(concat(lpad(hex(d0), 16, '0'), lpad(hex(d1), 16, '0'))) AS repeat", "k", "first AS start", f"n - 1 + {WIDTH} AS length")
    return inside.union(alone).distinct().join(texts.select("k", "doc_id"), "k").select("repeat", "doc_id", "start", "length")


def deduplicate(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each of docs: without the bytes of any 200-byte string that stands elsewhere too.

    A null text is empty; texts shorter than WIDTH lose nothing; matches don't cross rows; rows with the same text, and
    repeated rows, remove each other; null and repeated ids are as good as others. No documents give no rows. Other columns
    of docs, whatever their names, are left out. A long text is taken whole, by one task, at some 60 bytes of memory for each
    of its bytes.
    """
    texts, flags = repeated(docs, hot)

    def finish(found) -> pa.RecordBatch:
        rows = []
        for doc_id, text, pairs in found:
            drop = union(np.array([p["s"] for p in pairs], np.int64), np.array([p["e"] for p in pairs], np.int64), len(text))
            kept = np.frombuffer(text, np.uint8)[~drop].tobytes() if pairs else text
            rows.append((doc_id, len(text), len(text) - len(kept), len(runs(drop)[0]) if pairs else 0, hashlib.sha256(kept).hexdigest()))
        return batch_of(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], list(zip(*rows, strict=True)), [pa.int64()] * 4 + [pa.string()])

    return remove(texts, flags, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: For DuckDB. A text is its bytes in hexadecimal, so that a string's place is a byte's.
SQL = """
WITH h AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT r, x, unnest(range(0, greatest(len(x) // 2 - 199, 0), 500)) AS base FROM h
), y AS (
  SELECT r, base, substr(x, 2 * base + 1, 1398) AS part FROM b
), p AS (
  SELECT r, base, part, unnest(range(0, len(part) // 2 - 199)) AS i FROM y
), g AS (
  SELECT r, base + i AS i, md5_number(substr(part, 2 * i + 1, 400)) AS m FROM p
), t AS (
  SELECT m FROM g GROUP BY m HAVING count(*) > 1
), s AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM g WHERE m IN (SELECT m FROM t)
), n AS (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM s
), k AS (
  SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY r, span
), f AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM k
), c AS (
  SELECT f.r, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM f JOIN h ON f.r = h.r GROUP BY f.r
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN c ON h.r = c.r
"""
