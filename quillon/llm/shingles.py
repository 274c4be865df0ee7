"""Vectorised hashing of words and word shingles over batches of UTF-8 texts."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 1 << 16)
        step = np.full(size, _BASE, dtype=np.uint64)
        step[0] = 1
        back = np.full(size, _INVERSE, dtype=np.uint64)
        back[0] = 1
        _POW, _INV = np.cumprod(step), np.cumprod(back)
    return _POW, _INV


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [start, end) of buf; equal bytes give equal hashes wherever they stand."""
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts in order, and the number of words of each text."""
    buf = _LOWER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = np.empty(len(buf) + 1, dtype=bool)
    space[0] = True
    space[1:] = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])  # starts and ends alternate; the buffer ends with a space
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.diff(np.searchsorted(start, bounds))
    return range_hashes(buf, start, end), counts


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other and sorted within it, and the number for each.

    A text with fewer words than size has its whole sequence as its one shingle; a text without words has none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    odd = [np.uint64(int(_BASE) * (2 * k + 3) & (1 << 64) - 1 | 1) for k in range(size)]
    full = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size if len(full) else 0):
        full += words[k : k + len(full)] * odd[k]
    full = mix64(full)
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = owner[: len(full)] == owner[size - 1 :][: len(full)]
    hashes, docs = full[inside], owner[: len(full)][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += words[starts[short[has]] + k] * odd[k]
        extra = mix64(extra ^ mix64(counts[short].astype(np.uint64) + np.uint64(77)))
        hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[first], docs[first]
    return hashes, np.bincount(docs, minlength=len(texts)).astype(np.int64)
