"""Word shingles of whole texts as sorted distinct 64-bit hashes, by numpy over many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A word is a run of bytes other than these; A-Z are lower-cased.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

WIDTH = 5
BYTES_AT_ONCE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.Generator(np.random.PCG64(20240602)).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, kept per process up to the usual size."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n, BYTES_AT_ONCE + (1 << 17)) + 1
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= BYTES_AT_ONCE + (1 << 17) + 1:
        _powers[:] = made
    return made[0], made[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words up to its end."""
    flat = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    space = SPACE[flat]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # a start, an end, a start, ...
    starts, ends = edge[0::2], edge[1::2]
    powers, inverse = _powers_to(len(flat))
    sums = np.empty(len(flat) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[flat] * powers[: len(flat)], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.searchsorted(starts, limits)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles: of five words; a text of fewer words is one shingle, and one without words has none."""
    for group in _groups(texts):
        words, upto = word_hashes([t or b"" for t in group])
        n = len(words) - WIDTH + 1
        five = np.zeros(max(0, n), np.uint64)
        for i in range(WIDTH if n > 0 else 0):
            five += words[i : i + n] * _PLACE[i]
        five = mixed(five)
        start = 0
        for end in upto.tolist():
            if end - start >= WIDTH:
                yield np.unique(five[start : end - WIDTH + 1])
            elif end > start:
                w = words[start:end]
                yield mixed((w * _PLACE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
            else:
                yield np.empty(0, np.uint64)
            start = end


def _groups(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or b"")
        if size >= BYTES_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit number for the set: equal sets have equal numbers."""
    h = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))
    return int(mixed(h).view(np.int64)[0])
