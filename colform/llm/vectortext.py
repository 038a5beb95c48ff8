"""Vectorised text primitives on flat numpy arrays: words, hashes, ragged gathers."""

from __future__ import annotations

import hashlib

import numpy as np

#: Odd multipliers of the rolling hashes and of the final mixing.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: White space of the word contract: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def rolling_sums(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the weighted sum of bytes i..j-1; see ``span_hash``."""
    up, _ = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans [start, end)."""
    _, down = _POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Masks of the first 0..8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans longer than this are hashed one by one.
_LONG = 512


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def beginnings(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number, or all of a shorter one."""
    return view[starts] & _FIRST[np.minimum(ends - starts, 8)]


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """Keyed 64-bit hashes of the spans [start, end), of their length and all their bytes.

    Eight bytes at a time go through the keyed finaliser, which is not linear, so that no pair of strings collides whatever the key;
    spans over 512 bytes are hashed by keyed BLAKE2b. With a key drawn for the run, equal hashes cannot be prepared.
    """
    view = eights(data) if view is None else view
    size = ends - starts
    salt = mix(np.array([key], np.uint64) ^ _BASE)
    out = mix(beginnings(view, starts, ends) ^ mix(size.astype(np.uint64) + salt))
    open_, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(open_):
        left = size[open_] - at
        out[open_] = mix((out[open_] + salt) ^ (view[starts[open_] + at] & _FIRST[np.minimum(left, 8)]))
        open_, at = open_[left > 8], at + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(key).to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal non-space runs of every text, and words before each text (length n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    out -= np.repeat(np.cumsum(lengths) - lengths, lengths)
    return out


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 for each pair, concatenated."""
    return ragged_arange(lengths) + np.repeat(starts, lengths)


def row_of(lengths: np.ndarray) -> np.ndarray:
    """Row number of each element of a ragged array."""
    return np.repeat(np.arange(len(lengths)), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def numbered(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of the columns get equal numbers, in the order of the rows' values."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out
