"""Stretches of words that repeat periodically, found by the runs theorem.

A run is a stretch of consecutive words with smallest period p that can't be longer with it. By the runs theorem each has a
root of p words that is, under one of the two orders of words, the longest Lyndon word that starts where it does; and that
word ends before the next suffix that is smaller. So the suffixes of a text are sorted, the next smaller values of the
inverse suffix array and of its negative give the longest Lyndon words under both orders, and a root is extended to both
sides by minima of the LCP array, whose sparse table stands over blocks of it.

Texts are sorted many at a time, each by itself, in NumPy: prefixes are doubled for those suffixes only that still agree
with another, and a suffix that leaves its group in a round gets its LCP there, from the minima of what is known. Suffixes
that share fewer words with their neighbours than any wanted run asks for can't start a root; a text of no others has no
run. All work is done where a text stands: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.kernels import SPACE, runs, text_arrays, union, words
from curatrix.sources.shared import table

LEAST_LENGTH, LEAST_POWER = 6, 4
_BLOCK, _TOGETHER = 16, 1 << 16
_UNKNOWN = np.iinfo(np.int32).max


class Minima:
    """Minima of any ranges of values: a sparse table over blocks, and at both ends of a range a block's values themselves."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        blocks = np.full(-(-len(values) // _BLOCK) * _BLOCK, _UNKNOWN, values.dtype)
        blocks[: len(values)] = values
        self.levels = [blocks.reshape(-1, _BLOCK).min(axis=1)]
        while 2 << (len(self.levels) - 1) <= len(self.levels[0]):
            width = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-width], self.levels[-1][width:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first] to values[last], which is not before first, for each of many."""
        out = np.empty(len(first), self.values.dtype)
        for i in range(0, len(first), _TOGETHER):
            out[i : i + _TOGETHER] = self._least(first[i : i + _TOGETHER], last[i : i + _TOGETHER])
        return out

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        steps = np.arange(_BLOCK)
        out = self.values[np.minimum(first[:, None] + steps, last[:, None])].min(axis=1)
        out = np.minimum(out, self.values[np.maximum(last[:, None] - steps, first[:, None])].min(axis=1))
        begin, end = -(-first // _BLOCK), (last + 1) // _BLOCK
        level = np.frexp(np.maximum(end - begin, 0))[1] - 1  # -1 where no whole block is inside
        for k, table_ in enumerate(self.levels):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(out[at], np.minimum(table_[begin[at]], table_[end[at] - (1 << k)]))
        return out


class Suffixes:
    """Sorted suffixes of texts: text t is symbols[bounds[t]:bounds[t + 1]], and so are its places in the sorted order."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray) -> None:
        n = len(symbols)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][text]
        key = text * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.ones(n + 1, bool)
        head[1:n] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
        lcp = np.where(head[:n], 0, _UNKNOWN).astype(np.int32)
        alike, h = np.flatnonzero(~(head[:-1] & head[1:])), 1
        while len(alike):
            at = order[alike]
            after = at + h
            second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)  # a text's end is before all
            key = rank[at] * (n + 2) + second
            by = np.argsort(key, kind="stable")
            order[alike], key, second = at[by], key[by], second[by]
            new = np.flatnonzero((key[1:] != key[:-1]) & ~head[alike[1:]]) + 1
            far = new[second[new - 1] > 0]
            lcp[alike[new]] = h
            lcp[alike[far]] = h + Minima(lcp).least(second[far - 1], second[far] - 1) if len(far) else 0
            head[alike[new]] = True
            rank[order[alike]] = np.maximum.accumulate(np.where(head[alike], alike, 0))
            alike, h = alike[~(head[alike] & head[alike + 1])], 2 * h
        self.order, self.rank, self.lcp, self._minima = order, rank, lcp, None

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b share, a and b being different."""
        self._minima = self._minima or Minima(self.lcp)
        a, b = self.rank[a], self.rank[b]
        return self._minima.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def next_smaller(values: list[int]) -> list[int]:
    """For each value the place of the first smaller one after it, or of the end."""
    out, open_ = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return out


def maximal_runs(symbols: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of each run of at least least_length symbols and least_power periods within a text, by start, then period."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    sorted_ = Suffixes(symbols, bounds)
    # the first root of a run starts within its first period: so many symbols at least are shared with the next root
    shared = lambda p: np.maximum(least_length - 2 * p, (least_power - 2) * p) + 1
    least = int(shared(np.arange(1, least_length + 1)).min())
    deep = np.flatnonzero(sorted_.lcp >= least)
    roots = []
    for t in np.unique(np.searchsorted(bounds, deep, side="right") - 1).tolist():
        lo, hi = int(bounds[t]), int(bounds[t + 1])
        for ranks in (sorted_.rank[lo:hi], -sorted_.rank[lo:hi]):
            after = np.array(next_smaller(ranks.tolist()))
            at = np.flatnonzero(after < hi - lo)
            roots.append(np.stack([at, after[at], np.zeros_like(at)]) + lo)
    if not roots:
        return none, none, none
    i, j, begin = np.concatenate(roots, axis=1)
    same = symbols[i] == symbols[j]
    i, j, begin = i[same], j[same], begin[same]
    p, reach = j - i, sorted_.common(i, j)
    far = reach >= shared(p)
    i, p, begin, end = i[far], p[far], begin[far], (j + reach)[far]
    first = np.lexsort((i, p, end))  # roots of a run agree in its end and period: the first of them stands for it
    i, p, begin, end = i[first], p[first], begin[first], end[first]
    once = np.ones(len(i), bool)
    once[1:] = (p[1:] != p[:-1]) | (end[1:] != end[:-1])
    i, p, low, end = i[once], p[once], begin[once], end[once]
    high = i.copy()  # the first place from which all symbols to i recur one period later is not before low, not after high
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        recurs = sorted_.common(mid, mid + p[open_]) >= i[open_] - mid
        high[open_] = np.where(recurs, mid, high[open_])
        low[open_] = np.where(recurs, low[open_], mid + 1)
    length = end - high
    long = np.flatnonzero(length >= np.maximum(least_length, least_power * p))
    long = long[np.lexsort((p[long], high[long]))]
    return high[long], length[long], p[long]


def collapse(docs: DataFrame, keep: Sequence[str] = ("doc_id",), least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> DataFrame:
    """The columns `keep` of docs, runs (start, length and period of each, in words from 0, by start, then period) and collapsed, one row for each of docs.

    collapsed has the words that no run contains after its first period, joined by one space. A null or empty text has no
    runs and an empty one; repeated rows and ids are rows like any other; no documents give no rows; columns that aren't
    kept, whatever their names, aren't read. A long text is taken whole, at some 250 bytes of memory for each of its words.
    """

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_arrays(piece.column(piece.schema.get_field_index("text")))
        begin, end, before = words(buf, at, SPACE)
        offsets = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        each = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(buf[~SPACE[buf]])])
        start, length, period = maximal_runs(each.dictionary_encode().indices.to_numpy().astype(np.int64), before, least_length, least_power)
        text = np.searchsorted(before, start, side="right") - 1
        stay = ~union(start + period, start + length, len(begin))
        whole, data, out = np.diff(np.concatenate(([0], np.cumsum(~stay)))[before]) == 0, buf.tobytes(), []
        for t, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            parts = data[a:b].split()
            if not whole[t]:
                parts = [w for s, e in zip(*runs(stay[before[t] : before[t + 1]]), strict=True) for w in parts[s:e]]
            out.append(b" ".join(parts))
        found = pa.StructArray.from_arrays([pa.array(start - before[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(piece.num_rows + 1)), pa.int32()), found)
        return batch_of(["runs", "collapsed"], [lists, pa.array(out, pa.binary()).cast(pa.string())], [lists.type, pa.string()])

    return map_texts(docs, run, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", keep=list(keep))


def with_periods(docs: DataFrame) -> DataFrame:
    """docs, in every tenth text of which (by the crc32 of doc_id) the words from some place on are replaced by the first of them, over and over. A row without an id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("w", F.when((h % 10 == 0), split)).withColumn("g", F.floor(h / 10))
    n = F.size("w")
    # a chosen text without words has no remainders; it stays as it is
    chosen = chosen.withColumn("a", F.when(n > 0, F.expr("g % size(w)"))).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(sequence(0, size(w) - 1), i -> w[int(IF(i < a, i, a + (i - a) % p))]), ' ')")
    return chosen.withColumn("text", F.when(n > 0, periodic).otherwise(F.col("text"))).drop("w", "g", "a", "p")


def strongest(found: str = "runs") -> Column:
    """Of an array of runs, by start, then period, the first with the greatest length / period; null if there is none."""
    return F.expr(f"aggregate({found}, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (best, r) -> IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", strongest())
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
