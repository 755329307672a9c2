"""Sets of word shingles as sorted 64-bit numbers, computed for a whole text at a time with NumPy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hashed(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of some bytes, and the place of its first byte.

    A word's number adds up a scattered number for each (place, byte), so it depends on all of it.
    """
    blank = _BLANK[raw]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.arange(len(raw), dtype=np.uint64)
    first = np.repeat(starts.astype(np.uint64), np.diff(np.append(starts, len(raw))))
    body = raw[starts[0] :]
    part = mix((_LOWER[body] if lower else body.astype(np.uint64)) | ((at[starts[0] :] - first) << np.uint64(8)))
    part[blank[starts[0] :]] = 0
    return mix(np.add.reduceat(part, starts - starts[0])), starts


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """One number for each word [^\\x20\\x09-\\x0D]+, in order; lower: with A-Z in lower case."""
    return _hashed(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), lower)[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as numbers, case kept, one text after the other, and the text of each."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    w, starts = _hashed(np.frombuffer(b" ".join(parts), np.uint8), lower=False)
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.empty(0, np.int64)
    return w, np.searchsorted(ends, starts, "right")


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of width words, sorted; fewer words make one shingle, no words none."""
    w = word_hashes(text or "")
    n = min(width, len(w))
    if not n:
        return w
    out = w[: len(w) - n + 1]
    for k in range(1, n):
        out = mix(out) + w[k : len(w) - n + 1 + k]
    return np.unique(mix(out + np.uint64(n)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets that aren't both empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
