"""Document fingerprints from prefix polynomial hashes.

A text's code points are hashed by polynomials in two bases modulo the prime 2**31 - 1. With the prefix arrays any span's
hash takes two look-ups, so spans are equal (but for one chance in 2**60 or so) if their hashes are, and the longest
common extension from two places is found by binary search. A fingerprint holds the whole text's hash and, for likeness,
a sketch: the hashes of all spans of SPAN code points, dealt to SLOTS by their first bits, with the least of each slot
kept in one byte. Likeness is the Dice coefficient of the two span sets that the sketches show (1 for equal hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of
from curatrix.llm.kernels import mix
from curatrix.llm.rows import row_key
from curatrix.sources.shared import materialize, table

PRIME = (1 << 31) - 1
BASES = (1_000_003, 1_315_423_911)
SPAN, SLOTS = 8, 128

BLOCK = 1 << 18  # code points whose hashes are made at a time
WAYS = 32  # lengths that one step of a search for an extension tries

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x < 2**62."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x == p, np.uint64(0), x)


def _series(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    done = 1
    while done < n:
        take = min(done, n - done, BLOCK)
        out[done : done + take] = _reduce(out[:take].astype(np.uint64) * np.uint64(pow(base, done, PRIME)))
        done += take
    return out


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses, kept for the longest text so far: 16 bytes for each of its code points."""
    if not _tables or len(_tables[0][0]) < n:
        size = max(1 << 17, n)
        _tables[:] = [(_series(b, size), _series(pow(b, -1, PRIME), size)) for b in BASES]
    return _tables


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix arrays of a text, for comparing its spans with its own and other texts': 8 bytes for each code point."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = n = len(points)
        self.sums = [np.zeros(n + 1, np.uint32) for _ in BASES]
        for out, (power, _) in zip(self.sums, _powers(n + 1), strict=True):
            for at in range(0, n, BLOCK):
                values = _reduce((points[at : at + BLOCK].astype(np.uint64) + np.uint64(1)) * power[at : min(n, at + BLOCK)])
                values[0] += out[at]
                out[at + 1 : at + 1 + len(values)] = _reduce(np.cumsum(values))

    def span(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of [start, end), the same wherever a span stands."""
        p = np.uint64(PRIME)
        a, b = (_reduce(_reduce(s[end].astype(np.uint64) + p - s[start]) * inverse[start].astype(np.uint64)) for s, (_, inverse) in zip(self.sums, _powers(self.n + 1), strict=True))
        return a << np.uint64(31) | b

    def whole(self, n: int | None = None, then: Prefixes | None = None, m: int = 0) -> int:
        """Hash of the first n code points (of all), followed by the first m of another text."""
        n = self.n if n is None else n
        out = 0
        for k, (power, _) in enumerate(_powers(n + 1)):
            more = int(then.sums[k][m]) * int(power[n]) if then is not None else 0
            out = out << 31 | (int(self.sums[k][n]) + more) % PRIME
        return out

    def extension(self, other: Prefixes, i: int = 0, j: int = 0) -> int:
        """Length of the longest common extension of this text from i and the other from j: a search that halves what is left several times a step."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            tried = np.unique(np.linspace(low + 1, high, min(WAYS, high - low)).astype(np.int64))
            start, same = np.full(len(tried), i), np.full(len(tried), j)
            equal = int((self.span(start, i + tried) == other.span(same, j + tried)).sum())
            high = high if equal == len(tried) else int(tried[equal]) - 1
            low = low if equal == 0 else int(tried[equal - 1])
        return low

    def least(self, first: int, last: int) -> np.ndarray:
        """The least hash of each slot among the spans of SPAN code points that begin from first to before last; the greatest value if none."""
        out = np.full(SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(first, last, BLOCK):
            start = np.arange(at, min(last, at + BLOCK))
            h = np.sort(mix(self.span(start, start + SPAN)))
            begin = np.searchsorted(h, _EDGES)
            there = np.append(begin[1:], len(h)) > begin
            out[there] = np.minimum(out[there], h[begin[there]])
        return out

    def sketch(self) -> np.ndarray:
        """A byte for each slot: 0 if no span fell there, else 1 + the least hash modulo 255. A shorter text is one span."""
        if not self.n:
            return np.zeros(SLOTS, np.uint8)
        if self.n < SPAN:
            h = mix(self.span(np.zeros(1, np.int64), np.full(1, self.n)))
            out = np.full(SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
            out[int(h[0]) >> 64 - SLOTS.bit_length() + 1] = h[0]
            return _bytes(out)
        return _bytes(self.least(0, self.n - SPAN + 1))

    def fingerprint(self) -> tuple[int, int, np.ndarray]:
        return self.n, self.whole(), self.sketch()


_EDGES = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS.bit_length() + 1)


def _bytes(least: np.ndarray) -> np.ndarray:
    return np.where(least == np.uint64(0xFFFFFFFFFFFFFFFF), 0, 1 + least % np.uint64(255)).astype(np.uint8)


def joined_fingerprint(own: Prefixes, a: int, following: Prefixes, b: int, around: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The fingerprint of own's first a code points and following's first b, at least SPAN of each, from their prefix arrays.

    around: the SPAN - 1 code points before and after where they meet; only spans across it are new.
    """
    least = np.minimum(own.least(0, a - SPAN + 1), following.least(0, b - SPAN + 1))
    across = Prefixes(around).least(0, SPAN - 1)
    return a + b, own.whole(a, following, b), _bytes(np.minimum(least, across))


def as_string(fp: tuple[int, int, np.ndarray]) -> str:
    return f"{fp[0]:x}-{fp[1]:016x}-{fp[2].tobytes().hex()}"


def from_string(text: str) -> tuple[int, int, np.ndarray]:
    n, whole, sketch = text.split("-")
    return int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(sketch), np.uint8)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """0 to 1 from the fingerprints alone; two bytes of different spans agree once in 255."""
    if a[:2] == b[:2]:
        return 1.0
    either = int(((a[2] > 0) | (b[2] > 0)).sum())
    if not either:
        return 0.0
    j = (int(((a[2] == b[2]) & (a[2] > 0)).sum()) / either - 1 / 255) / (1 - 1 / 255)
    return min(1.0, max(0.0, 2 * j / (1 + j)))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by as many first ones (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


class _Held:
    """A document with its prefix arrays and fingerprint."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.points = code_points(self.text)
        self.prefixes = Prefixes(self.points)
        self.fp = self.prefixes.fingerprint()

    def result(self, following: _Held) -> tuple:
        new = edited(self.text, following.text)
        a = self.prefixes.n - self.prefixes.n // 2
        b = len(new) - a
        if min(a, b) >= SPAN:
            around = np.concatenate((self.points[a - SPAN + 1 : a], following.points[: SPAN - 1]))
            fp = joined_fingerprint(self.prefixes, a, following.prefixes, b, around)
        else:
            fp = Prefixes(code_points(new)).fingerprint()
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        common = a + self.prefixes.extension(following.prefixes, a)  # up to there the texts are one
        return self.doc_id, self.prefixes.n, digest, as_string(self.fp), as_string(fp), likeness(self.fp, fp), likeness(self.fp, following.fp), common, self.prefixes.extension(following.prefixes)


def _rows(found: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return batch_of(names, list(zip(*found, strict=True)) if found else [[] for _ in types], types)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each of docs, in ascending doc_id (null first, equal ids by content), with its next document's likeness.

    A null text is empty; no documents give no rows; other columns of docs, whatever their names, aren't read. A long text is
    held whole with the next one, at some 40 bytes of memory for each code point. A single document is its own next. common_edited and common_next: lengths of the longest common
    prefixes. Texts are shuffled once, to ranges of doc_id; each range's last document meets the next range's first in a
    second step, on one row for each range.
    """
    rows = docs.select("doc_id", row_key().alias("k"), "text").repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, before = TaskContext.get().partitionId(), None
        blank = (None,) * len(_NAMES)
        names, types = ["pid", "edge", "text", *_NAMES], [pa.int64(), pa.string(), pa.string(), *_TYPES]
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = _Held(doc_id, text)
                if before is None:
                    found.append((pid, "first", here.text, doc_id, *blank[1:]))
                else:
                    found.append((pid, None, None, *before.result(here)))
                before = here
                if len(found) >= 1000:
                    yield _rows(found, names, types)
                    found = []
            if found:
                yield _rows(found, names, types)
        if before is not None:
            yield _rows([(pid, "last", before.text, before.doc_id, *blank[1:])], names, types)

    parts = materialize(rows.select("doc_id", "text").mapInArrow(run, f"pid long, edge string, text string, {_RESULT}"), "fingerprints")
    first = parts.filter("edge = 'first'").select("pid", "doc_id", "text")
    # a row for each range: windows over them don't grow with the documents
    order = Window.orderBy("pid")
    ring = first.select("pid", F.coalesce(F.lead("pid").over(order), F.min("pid").over(Window.partitionBy())).alias("next"))
    last = parts.filter("edge = 'last'").select("pid", F.col("doc_id").alias("id"), F.col("text").alias("own")).join(ring, "pid")
    met = last.join(first.withColumnRenamed("pid", "next"), "next").select("id", "own", "doc_id", "text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, x, b, y = (batch.column(i)[row].as_py() for i in range(4))
                yield _rows([_Held(a, x).result(_Held(b, y))], _NAMES, _TYPES)

    return parts.filter("edge IS NULL").select(*_NAMES).union(met.mapInArrow(close, _RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
