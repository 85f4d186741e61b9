"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles that a document must contain whole. Shingles are ordered by how rare they are
in the corpus; as all of a window must be found, its prefix of one shingle, the rarest, is what is joined. Each match is
then held to bounds of length and position (the window must lie inside the document around the matched shingle) and
verified, first by hash and then word for word, over the window's whole width.

The benchmark is the stated query set: it is taken in blocks of at most BLOCK_WINDOWS windows and as many bytes as those
usually have, each broadcast on its own, so that what is broadcast never grows with either side. With one block (any usual
benchmark) documents are neither shuffled nor sorted. The items of a window stay in Spark: a window carries the key of its
set of items, a document the sets that it meets, and names are put together once for each different combination of sets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.kernels import LOWER, NOT_ALNUM, prefix, spans, text_arrays, union, words
from curatrix.sources.shared import materialize, table

#: Words in a window, and in a shingle of it.
WINDOW, SHINGLE = 13, 3
#: Windows broadcast at a time, and the bytes of text that go for one of them.
BLOCK_WINDOWS, WINDOW_BYTES = 200_000, 200
#: A document is contaminated if so many of its words in a hundred are hit.
PERCENT = 5
_SCREEN = 20  # bits of the hash that a table of one byte each is asked for before the search


@dataclass
class Block:
    """Windows by key. window i has key keys[k] at words[i] of its words from its start, for first[k] <= i < first[k + 1]."""

    lengths: list[int]
    screen: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    width: np.ndarray
    hashed: np.ndarray
    texts: list[bytes]
    sets: list[bytes]


@dataclass
class Hashed:
    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    per_text: np.ndarray
    sums: np.ndarray

    def shingles(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of `length` words that lie inside one text: their first words and hashes."""
        n = len(self.start) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n)
        text = np.repeat(np.arange(len(self.per_text) - 1), np.diff(self.per_text))
        at = at[text[:n] == text[length - 1 :]]
        return at, spans(self.sums, at, at + length)

    def words_of(self, first: int, width: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[first : first + width], self.end[first : first + width], strict=True))


def hashed(column: pa.Array) -> Hashed:
    buf, at = text_arrays(column)
    low = LOWER[buf]
    start, end, per_text = words(low, at, NOT_ALNUM)
    each = spans(prefix(low.astype(np.uint64) + np.uint64(1)), start, end)
    return Hashed(low, start, end, per_text, prefix(each))


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """window (words joined by a space), item: each distinct window of each item."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        h = hashed(piece.column(1))
        out: dict[tuple[str, str], None] = {}
        for k, item in enumerate(piece.column(0).to_pylist()):
            a, b = int(h.per_text[k]), int(h.per_text[k + 1])
            for i in range(a, max(a + 1, b - width + 1)) if b > a else ():
                out[h.words_of(i, min(width, b - a)).decode("utf-8", "surrogateescape"), item] = None
        return batch_of(["window", "item"], [[w for w, _ in out], [i for _, i in out]], [pa.string(), pa.string()])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return map_texts(items, run, "window string, item string").distinct()


def item_sets(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """window, set of each window, and set, item: the members of each different set of items, once however many windows have it.

    Sets are told apart by their size and 128 bits that don't depend on order, so no window's items are gathered anywhere.
    """
    bits = F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(1), "item"))
    sets = materialize(pairs.groupBy("window").agg(F.unhex(F.md5(F.concat_ws(":", F.count("*"), *bits).cast("binary"))).alias("set")), "windows")
    chosen = sets.groupBy("set").agg(F.min("window").alias("window"))
    return sets, pairs.join(chosen, "window").select("set", "item")


def _window_hash(text: bytes) -> tuple[np.ndarray, np.uint64]:
    h = hashed(pa.array([text.decode()]))
    n = len(h.start)
    return h.sums, spans(h.sums, np.array([0]), np.array([n]))[0]


def _plan(rows: list[tuple[str, bytes]]) -> tuple[list[tuple], np.ndarray]:
    """For each window its text, set of items, width, hash and shingles (hash by offset); and all the shingles, sorted."""
    out = []
    for window, its_set in rows:
        text = window.encode()
        sums, whole = _window_hash(text)
        width = len(sums) - 1
        length = min(SHINGLE, width)
        at = np.arange(width - length + 1)
        out.append((text, its_set, width, whole, length, spans(sums, at, at + length)))
    return out, np.unique(np.concatenate([x[5] for x in out])) if out else np.zeros(0, np.uint64)


def _screen(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _SCREEN, bool)
    table[(keys >> np.uint64(64 - _SCREEN)).astype(np.int64)] = True
    return table


def _find(h: np.ndarray, keys: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are among the sorted keys, and which key each is."""
    maybe = np.flatnonzero(screen[(h >> np.uint64(64 - _SCREEN)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    true = keys[k] == h[maybe]
    return maybe[true], k[true]


def _rarity(docs: DataFrame, keys: np.ndarray, lengths: list[int]) -> dict[int, int]:
    """How often each shingle of the block stands in the corpus; a row for each shingle and task is all that is shuffled."""
    shared, screen = docs.sparkSession.sparkContext.broadcast(keys), _screen(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from curatrix.llm.kernels import pieces

        keys = shared.value
        count = np.zeros(len(keys), np.int64)
        for batch in batches:
            for piece in pieces(batch):
                h = hashed(piece.column(0))
                for length in lengths:
                    count += np.bincount(_find(h.shingles(length)[1], keys, screen)[1], minlength=len(keys))
        some = np.flatnonzero(count)
        yield batch_of(["k", "n"], [some, count[some]], [pa.int64(), pa.int64()])

    return {r.k: r.n for r in docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}


def _block(docs: DataFrame, rows: list[tuple[str, bytes]]) -> Block:
    plan, keys = _plan(rows)
    lengths = sorted({x[4] for x in plan})
    often = _rarity(docs, keys, lengths)
    n_docs = np.array([often.get(k, 0) for k in range(len(keys))], np.int64)
    chosen = []
    for i, (_, _, _, _, _, shingles) in enumerate(plan):
        k = np.searchsorted(keys, shingles)
        best = int(np.lexsort((k, n_docs[k]))[0])
        if n_docs[k[best]]:  # else no document has the window
            chosen.append((int(k[best]), best, i))
    chosen.sort()
    ks = np.array([c[0] for c in chosen], np.int64)
    used, first = np.unique(ks, return_index=True)
    at = [c[2] for c in chosen]
    return Block(lengths, _screen(keys[used]), keys[used], np.append(first, len(ks)), np.array([c[1] for c in chosen], np.int64), np.array([plan[i][2] for i in at], np.int64), np.array([plan[i][3] for i in at], np.uint64), [plan[i][0] for i in at], [plan[i][1] for i in at])


def _hits(h: Hashed, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of each window of the block that the texts contain."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    text = np.repeat(np.arange(len(h.per_text) - 1), np.diff(h.per_text))
    for length in b.lengths if len(b.keys) else ():
        at, hashes = h.shingles(length)
        which, k = _find(hashes, b.keys, b.screen)
        many = b.first[k + 1] - b.first[k]
        w = np.repeat(b.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        at = np.repeat(at[which], many)
        begin = at - b.offset[w]
        inside = (begin >= h.per_text[text[at]]) & (begin + b.width[w] <= h.per_text[text[at] + 1])
        begin, w = begin[inside], w[inside]
        same = spans(h.sums, begin, begin + b.width[w]) == b.hashed[w]
        found.append((begin[same], w[same]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, w = (np.concatenate(x) for x in zip(*found, strict=True))
    exact = np.array([h.words_of(i, b.width[k]) == b.texts[k] for i, k in zip(begin, w, strict=True)], bool)
    return begin[exact], w[exact]


def hits(docs: DataFrame, windows: DataFrame, keep: list[str], block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns `keep` of docs, then n_words, n_hit, sets (of items, sorted) and contaminated, one row for each of docs.

    windows: window, set, as item_sets gives them. Each block of windows costs two passes over docs.
    """
    spark = docs.sparkSession
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size.n // block_windows), -(-size.bytes // (block_windows * WINDOW_BYTES)))
    windows = windows.withColumn("b", F.pmod(F.xxhash64("window"), F.lit(n_blocks)))
    have = docs
    for i in range(n_blocks):
        rows = sorted((r.window, bytes(r["set"])) for r in windows.filter(F.col("b") == i).collect())
        shared = spark.sparkContext.broadcast(_block(docs, rows))
        final = i == n_blocks - 1

        def run(piece: pa.RecordBatch, shared=shared, final=final, later=i > 0) -> pa.RecordBatch:
            b, h = shared.value, hashed(piece.column(piece.schema.get_field_index("text")))
            begin, w = _hits(h, b)
            text = np.searchsorted(h.per_text, begin, side="right") - 1
            start, end = [begin], [begin + b.width[w]]
            sets: dict[int, set[bytes]] = defaultdict(set)
            for t, k in {*zip(text.tolist(), w.tolist(), strict=True)}:
                sets[t].add(b.sets[k])
            if later:
                for t, (pairs, met) in enumerate(zip(piece.column(piece.schema.get_field_index("_hits")).to_pylist(), piece.column(piece.schema.get_field_index("_sets")).to_pylist(), strict=True)):
                    sets[t].update(met)
                    start.append(h.per_text[t] + np.array(pairs[::2], np.int64))
                    end.append(h.per_text[t] + np.array(pairs[1::2], np.int64))
            hit = union(np.concatenate(start), np.concatenate(end), len(h.start))
            met = [sorted(sets.get(t, ())) for t in range(piece.num_rows)]
            if final:
                sums = np.concatenate(([0], np.cumsum(hit)))
                n_hit, n_words = np.diff(sums[h.per_text]), np.diff(h.per_text)
                return batch_of(["n_words", "n_hit", "sets", "contaminated"], [n_words, n_hit, met, (n_hit > 0) & (100 * n_hit >= PERCENT * n_words)], [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.bool_()])
            pairs = []
            for t in range(piece.num_rows):
                edge = np.diff(np.concatenate(([0], hit[h.per_text[t] : h.per_text[t + 1]].astype(np.int8), [0])))
                pairs.append(np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), 1).ravel().tolist())
            return batch_of(["_hits", "_sets"], [pairs, met], [pa.list_(pa.int64()), pa.list_(pa.binary())])

        if final:
            return map_texts(have, run, "n_words long, n_hit long, sets array<binary>, contaminated boolean", keep=keep)
        have = map_texts(have, run, "_hits array<long>, _sets array<binary>", keep=[*dict.fromkeys([*keep, "text"])])
    raise AssertionError


def flagged(docs: DataFrame, benchmark: DataFrame, keep: list[str], block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns `keep` of docs, then n_words, n_hit, contaminated: annotate without the names of items, for which no row is shuffled."""
    windows, _ = item_sets(materialize(windows_of(benchmark), "pairs"))
    return hits(docs, windows, keep, block_windows).drop("sets")


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns `keep` of docs, then n_words, n_hit, n_items, items_sha256, contaminated, one row for each of docs.

    A null text has no words; an item without words has no window; a null item_id counts as the empty string; repeated
    items count once; an empty benchmark hits nothing; no documents give no rows. Other columns of either table aren't read,
    so their names clash with nothing. A long text is taken whole, at some 100 bytes of memory for each of its words. Names
    are sorted and hashed once for each different combination of sets of items that some document meets, in one row: the
    digest asks for that. Documents that meet none aren't shuffled; `keep` is written once, so it had better be narrow.
    """
    keep = ["doc_id"] if keep is None else keep
    windows, members = item_sets(materialize(windows_of(benchmark), "pairs"))
    found = materialize(hits(docs, windows, keep, block_windows), "hits")
    combined = F.md5(F.array_join(F.transform("sets", F.hex), "").cast("binary"))
    met = found.filter(F.size("sets") > 0).withColumn("_met", combined)
    each = met.groupBy("_met").agg(F.min("sets").alias("sets")).select("_met", F.explode("sets").alias("set"))
    names = each.join(members, "set").groupBy("_met").agg(F.sort_array(F.collect_set("item")).alias("names"))
    told = names.select("_met", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    free = found.filter(F.size("sets") == 0).withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    return met.join(told, "_met").select(*keep, *_OUT).union(free.select(*keep, *_OUT))


_OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, table(spark, sf_dir, "benchmark"))


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0
), m AS (SELECT DISTINCT m FROM bw), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, m, unnest(range(1, greatest(1, len(w) - m + 2))) AS t(i)
), hit AS (
  SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM hit), unnest(range(i, i + m)) AS t(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
