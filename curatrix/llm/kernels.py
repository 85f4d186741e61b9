"""Array work on Arrow text columns: words, polynomial hashes and window minima of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1
#: Texts are handled in pieces of about so many bytes: small against a worker's memory, large against NumPy's cost per call.
PIECE = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_series(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept and grown as longer texts come."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(PIECE + 2, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = _powers[base] = (_power_series(base, size), _power_series(inverse, size))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3: polynomial hashes are weak in their low bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, with a leading 0."""
    p, _ = powers(len(values) + 1, base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of values[start:end], the same wherever the values stand."""
    _, inverse = powers(len(pre), base)
    return mix((pre[end] - pre[start]) * inverse[start])


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offset of each text in them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of batch whose texts have at most `most` bytes together; a longer text stands alone, whole."""
    i = batch.schema.get_field_index(column)
    _, at = text_arrays(batch.column(i))
    n, row = batch.num_rows, 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield batch.slice(row, end - row)
        row = end


def separators(allowed: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


#: The words' separators of the contracts that split on ASCII white space.
SPACE = separators(b" \t\n\x0b\x0c\r")
#: ... and of the one that takes ASCII digits, letters and whatever is not ASCII.
NOT_ALNUM = separators(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(buf: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in buf, and how many words stand before each text (one more entry than texts)."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~separator[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[at] = True  # a text's first byte begins a word whatever stands before it
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order. Sorting integers is far faster than the hashing that NumPy's unique does."""
    out = np.sort(values)
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def union(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True where any of the intervals covers one of n positions."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0
