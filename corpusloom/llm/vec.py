"""Whole batches of texts as NumPy arrays: characters, words and their hashes.

Everything is done per batch of Arrow rows on flat arrays, so that no Python code
runs per character or per word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Code points beyond this are treated as the last one (planes above hold no words we classify).
LIMIT = 0x30000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


@functools.cache
def alnum() -> np.ndarray:
    """bool per code point: letter or digit, as ``str.isalnum`` has it."""
    return np.array([chr(c).isalnum() for c in range(LIMIT)], dtype=bool)


@functools.cache
def lower() -> np.ndarray:
    """The lower-case code point, where it is a single one."""
    out = np.arange(LIMIT, dtype=np.uint32)
    for c in range(LIMIT):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text starts (one more for the end)."""
    flat = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return flat, starts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(n, _BASE_INV, dtype=np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span; equal spans have equal hashes."""
    n = len(values) + 1
    up, down = _powers(1 << (n - 1).bit_length())
    total = np.zeros(n, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


class Words:
    """The words (runs of letters or digits, lower-cased) of a batch of texts."""

    def __init__(self, texts: list[str]):
        self.n_docs = len(texts)
        raw, self.doc_start = codes(texts)
        raw = np.minimum(raw, LIMIT - 1)
        self.raw = raw
        self.low = lower()[raw]
        edge = np.diff(np.concatenate(([False], alnum()[raw], [False])).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        #: the index of each text's first word, and one more for the end
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.hash = span_hashes(self.low, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the number of each one's text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = mix(h + self.hash[j : j + n] * np.uint64(2 * j + 3))
        whole = self.doc[:n] == self.doc[k - 1 : k - 1 + n]
        return h[whole], self.doc[:n][whole]


def slices(texts: list[str], max_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay near ``max_chars``, to bound memory; a long text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
