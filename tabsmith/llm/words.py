"""Words and their 64-bit hashes for whole batches of texts, as array operations on the bytes.

A word's hash depends on its bytes alone: a random number for each byte value, times a power of an odd
constant for the place in the word, summed modulo 2**64 and mixed. Sums over ranges come from one running
sum, so a word costs no Python step. Two given words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z

#: Separators of words: white space of the contract (0x20, 0x09-0x0D) ...
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ... or everything in ASCII but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_POWERS = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the row bounds in words (n + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    inside = ~separator[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower case in A-Z, and the row bounds in words."""
    starts, ends, rows = word_spans(data, bounds, separator)
    return span_hashes(data, starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words in a row and the row bounds.

    ``short``: a row with 1 to n - 1 words gives one shingle, the whole row; otherwise none.
    """
    count = np.diff(rows)
    out_n = np.where(count >= n, count - n + 1, (count > 0) if short else 0)
    out_rows = np.concatenate([[0], np.cumsum(out_n)])
    row = np.repeat(np.arange(len(count)), out_n)
    first = rows[:-1][row] + (np.arange(out_rows[-1]) - out_rows[:-1][row])
    length = np.minimum(count[row], n)
    h = np.zeros(len(first), np.uint64)
    for j in range(n):
        more = j < length
        at = first[more] + j
        h[more] = mix(h[more] * _ODD + words[at] + np.uint64(j + 1))
    return h, out_rows
