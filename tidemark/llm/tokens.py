"""Words of Arrow texts as byte ranges, and their 64-bit hashes, in numpy.

All functions work on a batch of texts at once: `data` is the UTF-8 bytes of all texts one after
another and `bounds` the n + 1 byte positions at which they begin and end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Lower-cases A-Z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space (0x20, 0x09-0x0D) separates.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, letters and everything beyond ASCII; for lower-cased data.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256).astype(_U) * _U(2) + _U(1)
_P = int(_rng.integers(2**62, 2**63)) | 1
_P_INV = pow(_P, -1, 2**64)
_Q = [_U(int(x) | 1) for x in _rng.integers(2**62, 2**63, 64)]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
#: Powers that are kept between batches; longer texts make their own.
_MOST_KEPT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def lower(data: np.ndarray) -> np.ndarray:
    """LOWER of all bytes."""
    return data | ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, bounds) of a large_string array without nulls."""
    n = len(texts)
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(bounds[0]), int(bounds[-1])
    data = np.frombuffer(values, np.uint8, last - first, first) if values is not None and last > first else np.zeros(0, np.uint8)
    return data, bounds - first


def words(data: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 word numbers at which the texts begin. of: the bytes of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = of[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(data)]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[(cut[cut > 0]) - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those of usual pieces are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_P, _P_INV):
        x = np.full(max(n, min(n + n // 4, _MOST_KEPT)), _U(base), _U)
        x[0] = 1
        made.append(np.cumprod(x, dtype=_U))
    if len(made[0]) <= _MOST_KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def power(n: int) -> int:
    """The factor of the byte at place n in prefix()."""
    return pow(_P, n, 2**64)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which span_hashes() takes the hash of any byte range."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    # In place, as fresh memory for each step would take longer than the step.
    np.take(_BYTE, data, out=out[1:], mode="clip")
    out[1:] *= up[:-1]
    return np.cumsum(out, out=out)


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: equal bytes, equal hashes, wherever they stand."""
    _, down = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix(data), starts, ends)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, by the first; windows also cross texts, so callers mask those."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = np.zeros(len(hashes) - n + 1, _U)
    for j in range(n):
        out += hashes[j : len(hashes) - n + 1 + j] * _Q[j]
    return mix(out + _U(n))


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the words' values by text."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]
