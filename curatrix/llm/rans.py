"""A static range asymmetric numeral system over token ids, many lanes at a time.

Block layout, little-endian: a header (HEADER), the documents' ids' counts (u4 each), CHECKPOINT records (position in the
words u8, then a state u8 for each lane), then the words (u4). Token t stands in lane t % lanes and row t // lanes; all
lanes are read in step, so one NumPy operation serves a row. The frequency table is shared by all blocks; a block names it
by its CRC. Decoding can begin at any checkpoint, and each block checks a CRC over all that follows its header.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: magic, version, flags, table's CRC, documents, tokens, lanes, rows between checkpoints, checkpoints, words, body's CRC
HEADER = struct.Struct("<4sHHIIQIIIQI")
MAGIC, VERSION = b"RANB", 1
#: Frequencies sum to 2**PRECISION; states stay in [2**31, 2**63).
PRECISION = 20
LOW = np.uint64(1 << 31)
LANES, ROWS_BETWEEN = 1024, 256


@dataclass
class Table:
    """Quantised frequencies by symbol; symbols that never occur have 0."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def quantise(counts: np.ndarray, precision: int = PRECISION) -> Table:
    """Frequencies in proportion to counts, at least 1 for each symbol that occurs, that sum to 2**precision."""
    total, seen = 1 << precision, np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(seen):
        return Table(freq)
    if len(seen) > total:
        raise ValueError(f"{len(seen)} symbols don't fit in {total} slots")
    exact = counts[seen].astype(np.float64) * (total - len(seen)) / counts[seen].sum()
    part = 1 + np.floor(exact).astype(np.int64)
    order = np.lexsort((seen, -(exact - np.floor(exact))))
    part[order[: total - part.sum()]] += 1
    freq[seen] = part
    return Table(freq)


def encode_block(ids: np.ndarray, lengths: np.ndarray, table: Table, lanes: int = LANES, between: int = ROWS_BETWEEN) -> bytes:
    """A block of the documents whose ids, one after another, are `ids`."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    rows = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * rows
    marks: list[tuple[int, np.ndarray]] = []
    shift, up, keep = np.uint64(PRECISION), np.uint64(63 - PRECISION), np.uint64(32)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id that the frequency table doesn't have")
    for r in range(rows - 1, -1, -1):
        f, c = freq[r * lanes : (r + 1) * lanes], start[r * lanes : (r + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << up)
        if full.any():
            words[r] = x[full].astype(np.uint32)
            x = np.where(full, x >> keep, x)
        q = x // f
        state[: len(f)] = (q << shift) + (x - q * f) + c
        if r % between == 0:
            marks.append((r, state.copy()))
    sizes = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    marks.reverse()
    body = b"".join([lengths.astype("<u4").tobytes(), *(struct.pack("<Q", sizes[r]) + s.astype("<u8").tobytes() for r, s in marks), *(w.astype("<u4").tobytes() for w in words)])
    return HEADER.pack(MAGIC, VERSION, 0, table.crc, len(lengths), n, lanes, between, len(marks), int(sizes[-1]), zlib.crc32(body)) + body


def decode_block(block: bytes, table: Table, part: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids and lengths of a block's documents; part: only the ids from that checkpoint to the next."""
    magic, version, _, crc, n_docs, n, lanes, between, n_marks, n_words, body_crc = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    if crc != table.crc:
        raise ValueError("the block was written with another frequency table")
    if zlib.crc32(body) != body_crc:
        raise ValueError("the block's checksum doesn't match")
    lengths = np.frombuffer(body, "<u4", n_docs)
    at, mark = 4 * n_docs, 8 * (1 + lanes)
    words = np.frombuffer(body, "<u4", n_words, at + n_marks * mark).astype(np.uint64)
    rows, first, last = -(-n // lanes), 0, n_marks
    if part is not None:
        first, last = part, part + 1
    if not n:
        return np.zeros(0, np.uint32), lengths
    pos = int(np.frombuffer(body, "<u8", 1, at + first * mark)[0])
    state = np.frombuffer(body, "<u8", lanes, at + first * mark + 8).astype(np.uint64)
    begin, end = first * between, min(rows, last * between)
    out = np.empty((end - begin) * lanes, np.uint32)
    slots, freq, start = table.slots, table.freq, table.start
    mask, shift, keep = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    for r in range(begin, end):
        width = min(lanes, n - r * lanes)
        x = state[:width]
        low = x & mask
        symbol = slots[low]
        out[(r - begin) * lanes : (r - begin) * lanes + width] = symbol
        x = freq[symbol] * (x >> shift) + low - start[symbol]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << keep) | words[pos : pos + len(need)]
            pos += len(need)
        state[:width] = x
    return out[: min(end * lanes, n) - begin * lanes], lengths
