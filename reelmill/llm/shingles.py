"""Sets of word shingles as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

#: Characters of text that are hashed together.
TOGETHER = 1 << 20

_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads close values over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(width: int) -> np.ndarray:
    """One odd factor per place; no sums of some equal sums of others."""
    return _mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)


def _sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    split = [t.encode().lower().split() for t in texts]  # bytes: A-Z and ASCII space only
    words = np.array([w for s in split for w in s], dtype=object)
    hashes = pd.util.hash_array(words) if len(words) else np.zeros(0, np.uint64)
    factors = _factors(width)

    def combined(h: np.ndarray, n: int, length: int) -> np.ndarray:
        total = np.zeros(n, np.uint64)
        for k in range(length):
            total += h[k : k + n] * factors[k]
        return _mixed(total + np.uint64(length))

    windows = combined(hashes, max(0, len(hashes) - width + 1), width)
    first = 0
    for s in split:
        n = len(s)
        if n >= width:
            yield np.unique(windows[first : first + n - width + 1]).view(np.int64)
        elif n:
            yield combined(hashes[first : first + n], 1, n).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
        first += n


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.  A shorter text is one run;
    a text without words has none.
    """
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1]) + 1
        if size >= TOGETHER:
            yield from _sets(some, width)
            some, size = [], 0
    if some:
        yield from _sets(some, width)
