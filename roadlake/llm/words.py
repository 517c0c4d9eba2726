"""Words of many texts at once as Arrow strings, A-Z folded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Mask = Callable[[np.ndarray], np.ndarray]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def pieces(data: np.ndarray, inside: Mask, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about so many bytes that end where no word goes on, so that one huge text is worked through in parts."""
    a, n = 0, len(data)
    while a < n:
        b = a + size
        while b < n:
            outside = np.flatnonzero(~inside(data[b - 1 : b + size])[1:])
            if len(outside):
                b += int(outside[0])
                break
            b += size
        b = min(b, n)
        yield a, b
        a = b


def words_of(data: np.ndarray, offsets: np.ndarray, inside: Mask, size: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' words in parts: the text of each word, all words' bytes end to end, and where each begins (one number more)."""
    for a, b in pieces(data, inside, size):
        part = data[a:b]
        own = inside(part)
        first = np.zeros(len(part) + 1, bool)
        lo, hi = np.searchsorted(offsets, [a, b])
        first[offsets[lo : hi + 1][offsets[lo : hi + 1] <= b] - a] = True  # a text's first byte never continues the last text's word
        before = np.concatenate([[False], own[:-1]])
        starts = np.flatnonzero(own & (~before | first[:-1]))
        if not len(starts):
            continue
        at = np.cumsum(own) - own  # where each byte goes
        yield np.searchsorted(offsets, starts + a, "right") - 1, _FOLD[part[own]], np.concatenate([at[starts], [own.sum()]])


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow strings from bytes that lie end to end."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
