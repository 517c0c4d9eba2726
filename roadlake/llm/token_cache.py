"""Token ids of words, kept between texts: words repeat far more often than texts do."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


class WordIds(dict):
    """Numbers words as they come; ids() gives the token ids of many words as one array. Forgets all when it holds `most` words, so memory stays bounded."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_600_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.sizes, self.at, self.flat, self.used, self.known = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = i = len(self)
        return i

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def ids(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words of these texts in order, and where each text's begin (n + 1 numbers)."""
        if len(self) >= self.most:
            self.forget()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if self.new:
            got = self.encode(self.new)
            n = np.fromiter(map(len, got), np.int64, len(got))
            a, b, total = self.known, self.known + len(got), int(n.sum())
            self.sizes, self.at, self.flat = self._room(self.sizes, b), self._room(self.at, b), self._room(self.flat, self.used + total)
            self.sizes[a:b], self.at[a:b] = n, self.used + np.cumsum(n) - n
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.used, self.known, self.new = self.used + total, b, []
        each = self.sizes[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = self.flat[np.repeat(self.at[index] - ends[:-1], each) + np.arange(ends[-1])]
        return flat, ends[np.concatenate([[0], np.cumsum(sizes)])]
