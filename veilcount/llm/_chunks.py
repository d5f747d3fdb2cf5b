"""Token ids of text by looking up chunks that tokenise independently of their neighbours.

Chunks are told apart by a 64-bit hash among the few hundred thousand that a worker keeps, so a wrong id
is expected once in about 5e13 chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated ranges start[i] .. start[i] + length[i] - 1."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = start - (np.cumsum(length) - length)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, length)


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all ids one after another)."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return lengths, np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum()))


class _Ids:
    """Ids of numbered chunks under one vocabulary."""

    def __init__(self) -> None:
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    def add(self, at: int, lengths: np.ndarray, found: np.ndarray) -> None:
        while at + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(found) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + len(lengths)] = lengths
        self.flat[self.used : self.used + len(found)] = found
        self.used += len(found)

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[slots]
        return lengths, self.flat[ragged(self.start[slots], lengths)]


class ChunkIds:
    """Ids of chunks, kept by the chunk's hash; forgets all of them beyond ``most`` chunks.

    encoders: one for each vocabulary, that gives the number of ids of each of a list of strings, and all of them.
    """

    def __init__(self, *encoders: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encoders, self.most = encoders, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids = [_Ids() for _ in self.encoders]

    def _add(self, keys: list[int], texts: list[tuple[str, ...]]) -> None:
        at = len(self.slot)
        for ids, encode, given in zip(self.ids, self.encoders, zip(*texts, strict=True), strict=True):
            ids.add(at, *encode(list(given)))
        self.slot.update(zip(keys, range(at, at + len(keys)), strict=True))

    def lookup(self, h: np.ndarray, text: Callable[[int], tuple[str, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By vocabulary (number of ids of each chunk, all ids one after another); text(i) is chunk i as each encoder is given it."""
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > max(self.most, len(keys)):
            self.clear()
        listed = keys.tolist()
        missing = [i for i, k in enumerate(listed) if k not in self.slot]
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            self._add([listed[k] for k in part], [text(int(first[k])) for k in part])
        slots = np.fromiter((self.slot[k] for k in listed), np.int64, len(listed))[inverse]
        return [ids.of(slots) for ids in self.ids]
