"""Distinct word-shingle sets of many texts at once, as 64-bit hashes, in numpy.

A batch's lower-cased bytes are hashed by prefix sums (random 64-bit value per byte,
powers of an odd base modulo 2^64), so every word costs the same few array
operations and no Python object. A shingle is a hash of its words' hashes in order.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_117)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 40, 1 << 63)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2, _A = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9FB21C651E98DF25)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; other seeds give other orders of the same values."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def unit_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of ``data`` between these places."""
    power, inverse = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_bounds(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one array of bytes; hashes, starts and ends of all their words; and how many words each text has."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    h = unit_hashes(data, starts, ends)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes))]))
    return data, h, starts, ends, counts


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts in a row, and how many each text has."""
    _, h, _, _, counts = word_bounds(raw)
    return h, counts


def shingle_sets(raw: list[bytes], k: int, limit: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingles of each lower-cased text; shorter texts have one, wordless ones none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= limit):
            size += len(raw[stop])
            stop += 1
        words, counts = word_hashes(raw[at:stop])
        with np.errstate(over="ignore"):
            h = np.zeros(max(0, len(words) - k + 1), np.uint64)
            for j in range(k):
                h = h * _A + words[j : j + len(h)]
            h = mix(h, k)
            begin = 0
            for n in counts.tolist():
                if n >= k:
                    out.append(np.unique(h[begin : begin + n - k + 1]))
                elif n:
                    x = np.zeros(1, np.uint64)
                    for w in words[begin : begin + n]:
                        x = x * _A + w
                    out.append(mix(x, n + 1000))
                else:
                    out.append(np.zeros(0, np.uint64))
                begin += n
        at = stop
    return out


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""
