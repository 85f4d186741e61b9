"""Removal of repeated runs of lines, cut at places that the content chooses.

A line's hash, rolled over LOOK lines, decides whether a chunk ends there; as only those lines matter, an insertion or
deletion elsewhere moves no other boundary; of boundaries one after another the one of the lesser choice (below) counts,
so that chunks of at least LEAST lines come in step as well. Chunks of at least two lines that stand more than once in the corpus are
compared byte for byte with the first of them (by document, then place) and removed where they are the same; the first
stays. Blank lines and white space at a line's end don't count for boundaries but do for equality.
Where MOST lines have no boundary of this kind, as in lines that repeat one after another, the chunk ends after that of them
which the hash of the WIDE lines up to it (its choice) makes the least, of equal ones the last. In periodic lines that is always the
same place of the period and as many periods on as fit, so their chunks are alike wherever the lines begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.anchors import texts_by_key
from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.kernels import MASK64, text_arrays
from curatrix.llm.rows import LAST_ID, row_key
from curatrix.sources.shared import table

LOOK, DIVISOR, LEAST, MOST, WIDE = 2, 4, 2, 32, 8
_ROLL = 0x9E3779B97F4A7C15


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """The text's chunks as byte ranges (start, end, lines); together they are the text."""
    lines = text.split(b"\n")
    if not lines[-1]:
        lines.pop()
    bodies = [line.rstrip() for line in lines]
    hashes = [xxhash.xxh3_64_intdigest(b) for b in bodies]
    ends = list(accumulate(len(line) + 1 for line in lines))
    wide: dict[int, int] = {}

    def choice(i: int) -> int:
        if i not in wide:
            wide[i] = xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little") for h in hashes[max(0, i - WIDE + 1) : i + 1]))
        return wide[i]

    ends_here, recent = [], []
    for body, h in zip(bodies, hashes, strict=True):
        if body:
            recent = [*recent, h][-LOOK:]
            rolled = 0
            for x in recent:
                rolled = (rolled * _ROLL + x) & MASK64
            ends_here.append((rolled >> 40) % DIVISOR == 0)
        else:
            ends_here.append(False)
    out: list[tuple[int, int, int]] = []
    start = first = i = 0
    while i < len(lines):
        n = i + 1 - first
        if n == MOST and not ends_here[i]:
            i = min(range(first + LEAST - 1, i + 1), key=lambda j: (choice(j), -j))
        elif n < LEAST or not ends_here[i] or n < MOST and i + 1 < len(lines) and ends_here[i + 1] and choice(i + 1) < choice(i):
            i += 1
            continue
        end = min(len(text), ends[i])
        out.append((start, end, i + 1 - first))
        start, first, i = end, i + 1, i + 1
    if start < len(text):
        out.append((start, len(text), len(lines) - first))
    return out


def _pairs(column: pa.Array) -> Iterator[bytes]:
    buf, at = text_arrays(column)
    data = buf.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b]


def _chunks_of(piece: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for k, doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), _pairs(piece.column(2)), strict=True):
        rows += [(xxhash.xxh3_128_digest(text[a:b]), k, doc, c) for c, (a, b, n) in enumerate(chunks(text)) if n >= 2]
    return batch_of(["digest", "k", "doc", "c"], list(zip(*rows, strict=True)) or [()] * 4, [pa.binary(), pa.binary(), pa.int64(), pa.int32()])


def _found(docs: DataFrame) -> DataFrame:
    """digest, k, doc, c: chunks of two lines or more."""
    rows = docs.select(row_key().alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), "text")
    return map_texts(rows, _chunks_of, "digest binary, k binary, doc long, c int")


def _bodies_of(piece: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for k, text, found in zip(piece.column(0).to_pylist(), _pairs(piece.column(2)), piece.column(3).to_pylist(), strict=True):
        parts = chunks(text)
        rows += [(x["digest"], k, x["c"], text[parts[x["c"]][0] : parts[x["c"]][1]]) for x in found]
    return batch_of(["digest", "k0", "c0", "body"], list(zip(*rows, strict=True)) or [()] * 4, [pa.binary(), pa.binary(), pa.int32(), pa.binary()])


def _bytes_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (digest, k, c) with the chunks' bytes."""
    per_row = wanted.groupBy("k").agg(F.collect_set(F.struct("digest", "c")).alias("found"))
    both = texts.join(per_row, "k").select("k", "doc_id", "text", "found")  # all of texts' columns, so that Spark shuffles them once for both joins
    return map_texts(both, _bodies_of, "digest binary, k0 binary, c0 int, body binary").dropDuplicates(["digest"])


def _without(piece: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc_id, text, found in zip(piece.column(0).to_pylist(), _pairs(piece.column(1)), piece.column(2).to_pylist(), strict=True):
        parts = chunks(text)
        same = {x["c"] for x in found or [] if text[parts[x["c"]][0] : parts[x["c"]][1]] == x["body"]}
        kept = b"".join(text[a:b] for c, (a, b, _) in enumerate(parts) if c not in same) if same else text
        lines = sum(n for _, _, n in parts)
        gone = sum(parts[c][2] for c in same)
        rows.append((doc_id, lines, gone, len(same), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return batch_of(_NAMES, list(zip(*rows, strict=True)), [pa.int64()] * 4 + [pa.string()] * 2)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_chunks (removed), kept_sha256 and text of what is left, of each of docs.

    A null text has no lines; no documents give no rows; other columns of docs, whatever their names, are left out. A null
    doc_id comes after all others. Texts are taken in pieces (see map_texts), a long one whole, at some 300 bytes of memory
    for each of its lines. Rows are told apart by doc_id and text: of rows that agree in both, each loses what an earlier
    document or place has, and they keep the same. Nothing is written: texts are cut once more instead, so docs should be a table.
    """
    docs = docs.select("doc_id", "text")
    texts = texts_by_key(docs)
    found = _found(docs)
    first = found.groupBy("digest").agg(F.min(F.struct("doc", "k", "c")).alias("at"), F.count("*").alias("times")).filter("times > 1")
    bodies = _bytes_of(texts, first.selectExpr("digest", "at.k AS k", "at.c AS c"))
    again = found.join(bodies, "digest").filter("k <> k0 OR c <> c0").select("k", F.struct("c", "body").alias("x"))
    per_row = again.groupBy("k").agg(F.collect_list("x").alias("found"))
    both = texts.join(per_row, "k", "left").select("doc_id", "text", "found")
    return map_texts(both, _without, "doc_id long, n_lines long, n_removed long, n_chunks long, kept_sha256 string, text string")


_NAMES = ["doc_id", "n_lines", "n_removed", "n_chunks", "kept_sha256", "text"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("text")
