"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

Texts come as the bytes of an Arrow column; all work is done on whole columns
of bytes and words, block by block, so memory does not depend on a text's
length beyond a few numbers per word.

A word's hash is a polynomial in its bytes with random coefficients per byte
value (mod 2**64), mixed with its length; a shingle's hash is a polynomial in
its words' hashes, mixed again.  Two different shingles get one hash with a
chance of about 2**-60, so sets of hashes stand for sets of shingles.
"""

from __future__ import annotations

import numpy as np

SEPARATORS = b" \t\n\v\f\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 18
_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SEPARATORS)] = True
_WEIGHT = np.random.default_rng(714).integers(1, 2**63, 256, np.uint64)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~_SEPARATES[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[:-1][~inside] = True
    cut[1:][~inside] = True
    starts = np.flatnonzero(inside & cut[:-1])
    ends = np.flatnonzero(inside & cut[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z if ``lower``."""
    weight = _WEIGHT[LOWER] if lower else _WEIGHT
    out = np.zeros(len(starts), np.uint64)
    total, up, down = 0, 1, 1
    for a in range(0, len(data), BLOCK):
        value = weight[data[a:a + BLOCK]]
        value *= _UP[:len(value)]
        value *= np.uint64(up)
        sums = np.cumsum(value)
        sums += np.uint64(total)
        i, j = np.searchsorted(starts, [a, a + BLOCK])
        at = starts[i:j] - a
        out[i:j] -= sums[at] - value[at]
        i, j = np.searchsorted(ends, [a + 1, a + BLOCK + 1])
        out[i:j] += sums[ends[i:j] - 1 - a]
        total = int(sums[-1])
        up = up * pow(_BASE, BLOCK, 1 << 64) & _MASK
    for a in range(0, len(data), BLOCK):
        i, j = np.searchsorted(starts, [a, a + BLOCK])
        out[i:j] *= _DOWN[starts[i:j] - a] * np.uint64(down)
        down = down * pow(_INVERSE, BLOCK, 1 << 64) & _MASK
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E6C63D0676A9A99))


def shingles(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``k`` words; a text with fewer words is one shingle."""
    if not len(words):
        return words, text
    factor = np.uint64(0xAEF17502108EF2D9)
    whole = np.zeros(0, np.int64)
    if len(words) >= k:
        whole = np.flatnonzero(text[:len(words) - k + 1] == text[k - 1:])
    out = words[whole].copy()
    for i in range(1, k):
        out *= factor
        out += words[whole + i]
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.append(first, len(text)))
    first, count = first[count < k], count[count < k]
    short = words[first].copy()
    for i in range(1, k - 1):
        more = count > i
        short[more] = short[more] * factor + words[first[more] + i]
    short += (count.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7)
    found, owner = np.concatenate([out, short]), np.concatenate([text[whole], text[first]])
    order = np.argsort(owner, kind="stable") if len(first) else slice(None)
    return mix(found[order]), owner[order]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text, A-Z taken as a-z."""
    starts, ends, text = spans(data, offsets)
    found, owner = shingles(hashes(data, starts, ends), text, k)
    at = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(found[a:b]) for a, b in zip(at, at[1:])]
