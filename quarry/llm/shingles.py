"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

SEED = 0x5EED
_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in order, and where each text's words end in that array."""
    joined = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    white = _WHITE[joined]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edge[::2], edge[1::2]  # the first and the last byte are white
    up, down = powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * up[:-1], out=total[1:])
    words = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])  # the blank behind each text
    return words, np.searchsorted(start, ends)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    if not texts:
        return []
    words, ends = word_hashes(texts)
    longer = np.concatenate([words, np.full(width, _NONE)])
    n = len(words)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        sums += longer[k:k + n] * _PLACE[k]
    sums = mixed(sums)
    out, lo = [], 0
    for hi in ends.tolist():
        if hi - lo >= width:
            out.append(np.unique(sums[lo:hi - width + 1]))
        elif hi > lo:
            short = np.concatenate([words[lo:hi], np.full(width - (hi - lo), _NONE)])
            out.append(mixed((short * _PLACE[:width]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        lo = hi
    return out
