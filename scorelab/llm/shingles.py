"""Word shingles of texts as sets of 64-bit hashes, and MinHash bands over them (numpy).

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text as they stand. A word's hash is a
polynomial over its bytes in 64 bits, mixed; a shingle's hash mixes those of its words in
order. Two different shingles share a hash with a chance of about 2^-64."""

from __future__ import annotations

import math

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_WORD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    pow_, inv = _powers(len(buf))
    total = np.cumsum(_BYTE[buf] * pow_, dtype=np.uint64)
    h = mix((total[ends - 1] - total[starts - 1]) * inv[starts] + (ends - starts).astype(np.uint64))
    upto = np.searchsorted(starts, ends_of, "left")
    return h, np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of 1 to ``width`` - 1 words has the
    one shingle of all its words; a text without words has none."""
    h, counts = word_hashes(texts)
    n = len(h) - width + 1
    s = np.zeros(max(0, n), np.uint64)
    for k in range(width):
        s += h[k:k + max(0, n)] * _WORD[k]
    s = mix(s)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(s[at:at + c - width + 1]))
        elif c:
            out.append(mix((h[at:at + c] * _WORD[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def bands_for(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """Bands and rows for MinHash banding: most rows (fewest false candidates) with which
    pairs at ``threshold`` share a band with at least ``recall``, using at most ``hashes``."""
    for rows in range(hashes, 0, -1):
        p = threshold ** rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("recall cannot be met with so few hashes")


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` signed 64-bit bucket keys for each (non-empty) set."""
    rng = np.random.Generator(np.random.PCG64(7))
    xor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    mul = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    all_, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), np.uint64(b + 1))
        for k in range(b * rows, (b + 1) * rows):
            low = np.minimum.reduceat(mix_light(all_ ^ xor[k]) * mul[k], starts)
            key = mix(key * np.uint64(_BASE) + low)
        out[:, b] = key
    return out.view(np.int64)


def mix_light(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(31))
