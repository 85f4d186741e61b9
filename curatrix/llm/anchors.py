"""Repeated passages found by anchors, for text cut into words or bytes.

Each window of a text chooses one of its grams, the one with the least hash (the first of equals): its anchor. Equal
windows choose equal anchors at equal places, wherever they stand, so passages that repeat are found by joining anchors
alone, of which there is about one for 22 windows of 50 words or 85 of 200 bytes. What is least depends on the window
alone: the first HASHED bits of its grams' hashes, then their places. An occurrence is a run of windows that chose the same
anchor; its span is all that those windows cover. Most texts share no anchor and end there. Occurrences with equal spans
are one case however many there are; only spans that share an anchor but differ need a closer look.

Spans and windows are held to be equal by 128 bits of BLAKE2b over their bytes, beside which an anchor's own hash matters
only for where they meet: anchors of different grams that collide cost time, never a false repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of
from curatrix.llm.kernels import SPACE, mix, pieces, powers, prefix, sliding_min, spans, text_arrays, words
from curatrix.llm.rows import LAST_ID, row_key
from curatrix.sources.shared import Scratch

SCHEMA = "anchor long, d0 long, d1 long, k binary, doc long, first int, n int, off int, rep boolean, sure boolean"
HASHED, PARTS, TOGETHER = 28, 64, 12  # bits of hash that order grams; parts that the rows of one key are dealt to; pieces whose equal spans become one
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 3 + [pa.binary(), pa.int64()] + [pa.int32()] * 3 + [pa.bool_()] * 2


@dataclass(frozen=True)
class Cut:
    """How texts are cut: windows of `window` units (words or bytes) whose grams have `gram` units."""

    words: bool
    window: int
    gram: int


@dataclass
class Units:
    """The units of a piece's texts: unit i is data[start[i]:end[i]]; text t has those from at[t] to at[t + 1]."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    hashed: np.ndarray


def cut(column: pa.Array, how: Cut) -> Units:
    buf, at = text_arrays(column)
    if not how.words:
        place = np.arange(len(buf) + 1)
        return Units(buf.tobytes(), place[:-1], place[1:], at, buf)
    start, end, per = words(buf, at, SPACE)
    each = spans(prefix(buf.astype(np.uint64) + np.uint64(1)), start, end)
    return Units(buf.tobytes(), start, end, per, each)


def joined(u: Units, first: int, last: int, how: Cut) -> bytes:
    """The units from first to before last as text: words are joined by one space."""
    if not how.words:
        return u.data[first:last]
    return b" ".join(u.data[u.start[first] : u.end[last - 1]].split())


def occurrences(u: Units, how: Cut) -> tuple[np.ndarray, ...]:
    """Of each occurrence: its anchor's hash, its text, its first window's first unit, the number of windows, the anchor's unit."""
    n, width = len(u.start), how.window - how.gram + 1
    if n < how.window:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    sums = prefix(u.hashed.astype(np.uint64) + np.uint64(1))
    grams = mix((sums[how.gram :] - sums[: -how.gram]) * powers(n + 1)[1][: n - how.gram + 1])
    low = (np.uint64(1) << np.uint64(64 - HASHED)) - np.uint64(1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width) & low
    text = np.repeat(np.arange(len(u.at) - 1), np.diff(u.at))
    whole = text[: n - how.window + 1] == text[how.window - 1 :]
    new = whole.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (text[1 : n - how.window + 1] != text[: n - how.window])
    begin = np.flatnonzero(new)
    stop = whole & ~np.append(whole[1:] & ~new[1:], False)
    end = np.flatnonzero(stop) + 1
    at = least[begin].astype(np.int64)
    return grams[at], text[begin], begin, end - begin, at


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _combine(anchor: np.ndarray, both: np.ndarray, doc: np.ndarray, by_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch stand for those equal to them, and which are repeats for sure.

    by_doc: only what also stands in an earlier document is a repeat, and all rows of the first document stand; else
    whatever stands twice is, and one row stands.
    """
    order = np.lexsort((doc, both[:, 1], both[:, 0], anchor))
    a, d, i = anchor[order], both[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    rep, sure = np.empty(len(order), bool), np.empty(len(order), bool)
    if by_doc:
        least = np.repeat(i[first], size)
        rep[order], sure[order] = i == least, i > least
    else:
        rep[order], sure[order] = new, np.repeat(size > 1, size)
    return rep, sure


def find(docs: DataFrame, how: Cut, by_doc: bool) -> DataFrame:
    """All occurrences in docs (doc_id, text): SCHEMA, with k the row's key and doc its id, a missing one last of all."""

    def joined_parts(parts: list[tuple]) -> pa.RecordBatch:
        anchor, found, k, *rest = zip(*parts, strict=True)
        anchor, rest = np.concatenate(anchor), [np.concatenate(x) for x in rest]
        both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        keys = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in k])
        return batch_of(_NAMES, [anchor, both[:, 0], both[:, 1], keys, *rest, *_combine(anchor, both, rest[0], by_doc)], _TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for piece in pieces(batch):
                u = cut(piece.column(2), how)
                anchor, text, first, n, at = occurrences(u, how)
                if not len(first):
                    continue
                view, last = u.data, first + n - 1 + how.window
                if how.words:
                    found = [digest(b" ".join(view[s:e].split())) for s, e in zip(u.start[first].tolist(), u.end[last - 1].tolist(), strict=True)]
                else:
                    found = [digest(view[s:e]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                k, doc = piece.column(0).take(pa.array(text)), piece.column(1).to_numpy()[text]
                parts.append((anchor.view(np.int64), b"".join(found), k, doc, first - u.at[text], n, at - first))
                if len(parts) == TOGETHER:
                    yield joined_parts(parts)
                    parts = []
            if parts:
                yield joined_parts(parts)

    rows = docs.select(row_key().alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), "text")
    return rows.mapInArrow(run, SCHEMA)


#: A span's digest in two halves: aggregates over longs need no sorting.
SPAN_KEY = ["anchor", "d0", "d1"]


def halves() -> list[Column]:
    """Least and greatest of both halves, l0, m0, l1, m1: equal if and only if all digests are."""
    return [F.min("d0").alias("l0"), F.max("d0").alias("m0"), F.min("d1").alias("l1"), F.max("d1").alias("m1")]


def texts_by_key(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs' k, doc_id, text dealt by k: with scratch as a table in buckets, which any number of jobs then read without a shuffle."""
    texts = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.repartition("k") if scratch is None else scratch.bucketed(texts, "texts", "k")


def each_part(parts: str) -> str:
    """SQL for a row for each part that is set in the bits `parts`."""
    return f"explode(filter(sequence(0L, {PARTS - 1}L), x -> (shiftrightunsigned({parts}, cast(x AS int)) & 1) = 1))"


def meeting(rows: DataFrame, keys: list[str], row: list[str], totals: list[Column], which: str) -> DataFrame:
    """rows (read twice, so best a table) whose key's totals fulfil the condition `which`, with these totals.

    No key's rows meet in one task: they are dealt to PARTS parts by their columns `row`; only totals are brought together,
    with the parts that they came from, and go back to each of them.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*row), F.lit(PARTS)))
    found = dealt.groupBy(*keys).agg(*totals, F.expr("bit_or(shiftleft(1L, cast(part AS int)))").alias("parts")).filter(which)
    return dealt.join(found.withColumn("part", F.expr(each_part("parts"))).drop("parts"), [*keys, "part"]).drop("part")


def spans_of(texts: DataFrame, wanted: DataFrame, how: Cut, make: Callable[[Units, int, dict], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows that make(units, the text's first unit, occurrence) gives for each occurrence in wanted (k, and others' columns)."""
    names = [c for c in wanted.columns if c != "k"]
    per_row = wanted.groupBy("k").agg(F.collect_list(F.struct(*names)).alias("found"))
    # rows that agree in all of k's columns are one here
    both = texts.join(per_row, "k").select("k", "doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                u = cut(piece.column(2), how)
                rows = [row for t, (k, found) in enumerate(zip(piece.column(0).to_pylist(), piece.column(3).to_pylist(), strict=True)) for x in found for row in make(u, int(u.at[t]), x | {"k": k})]
                if rows:
                    yield batch_of([x.split()[0] for x in schema.split(", ")], list(zip(*rows, strict=True)), types)

    return both.mapInArrow(run, schema)


def remove(texts: DataFrame, flags: DataFrame, finish: Callable[[Iterator[tuple[int | None, bytes, list[dict]]]], pa.RecordBatch], schema: str) -> DataFrame:
    """finish over (doc_id, text, intervals) of each row of texts, with the flags (k, s, e) of its key; one row for each."""
    per_row = flags.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    both = texts.join(per_row, "k", "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                buf, at = text_arrays(piece.column(1))
                data = buf.tobytes()
                found = piece.column(2).to_pylist()
                yield finish((i, data[a:b], f or []) for i, a, b, f in zip(piece.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), found, strict=True))

    return both.mapInArrow(run, schema)
