"""What a worker knows of the words it has met, in flat arrays that a whole piece of texts is looked up in at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")


class Known:
    """Texts with their ids: those of text number n are flat[start[n]:start[n] + size[n]]."""

    def __init__(self, kind: np.dtype) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size, self.used = np.zeros(1 << 20, kind), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def numbers(self, texts: list[str]) -> np.ndarray:
        """-1 for those that aren't known."""
        return np.fromiter(map(self.number.get, texts, repeat(-1)), np.int64, len(texts))

    def add(self, texts: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of texts, which are new; their ids stand one after another."""
        n = len(self.number)
        while n + len(texts) > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(texts)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(texts)] = size
        self.used += len(ids)
        self.number.update(zip(texts, range(n, n + len(texts)), strict=True))
        return np.arange(n, n + len(texts))

    def forget(self, keep: int) -> None:
        """All but the first `keep`, once there are more."""
        if len(self.number) > keep:
            while len(self.number) > keep:
                self.number.popitem()
            self.used = int(self.start[keep])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all `numbers`, one after another, and how many each has."""
        size = self.size[numbers].astype(np.int64)
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[numbers] - end + size, size) + np.arange(end[-1] if len(end) else 0)], size


_held: dict[tuple, object] = {}


def held(owner: tuple, make: Callable[[], T]) -> T:
    """The one large thing that a worker remembers between its tasks: it is made for an owner, and another owner's is dropped."""
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()
