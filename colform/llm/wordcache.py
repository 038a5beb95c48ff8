"""Token ids of the distinct words of a batch, kept between batches of a worker."""

from __future__ import annotations

import numpy as np

from . import vectortext as V


class WordCache:
    """``encode(data, starts, ends)`` gives (flat ids, ids a word) for some words; it is called once for each new word.

    Words are found by 64-bit hashes in an open-addressing table of arrays, and a found word counts only if its length and all its
    bytes are the same; different words of one hash are kept apart by their bytes in a dictionary. At ``limit`` words or
    ``limit_bytes`` of them the cache starts anew, so its memory is bounded.
    """

    def __init__(self, encode, limit: int = 1 << 20, limit_bytes: int = 32 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.bits = int(limit).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.sizes, self.beginnings = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)
        self.bytes, self.bytes_at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)
        self.others: dict[bytes, int] = {}
        self.words = self.used = self.used_bytes = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if len(a) >= n:
            return a
        return np.concatenate([a, np.zeros(max(n, len(a) * 3 // 2) - len(a), a.dtype)])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the word of each hash, -1 for a new one."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            number = self.number[at[open_]]
            hit = (number >= 0) & (self.keys[at[open_]] == keys[open_])
            out[open_[hit]] = number[hit]
            open_ = open_[(number >= 0) & ~hit]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New distinct hashes; of several that want a free slot one gets it and the others go on."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.number[at[open_]] < 0]
            self.number[at[free]], self.keys[at[free]] = numbers[free], keys[free]
            open_ = open_[self.number[at[open_]] != numbers[open_]]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)

    def _add(self, data: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new words, encoded and kept with their bytes."""
        flat, lengths = self.encode(data, starts, ends)
        n, sizes = self.words, ends - starts
        many = n + len(starts)
        for name in ("starts", "lengths", "sizes", "beginnings", "bytes_at"):
            setattr(self, name, self._room(getattr(self, name), many))
        own = slice(n, many)
        self.ids = self._room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[own], self.lengths[own] = self.used + V.offsets_of(lengths)[:-1], lengths
        self.sizes[own], self.beginnings[own] = sizes, V.beginnings(view, starts, ends)
        rest = np.maximum(sizes - 8, 0)
        raw = data[V.ragged_take(starts + 8, rest)]
        self.bytes = self._room(self.bytes, self.used_bytes + len(raw))
        self.bytes[self.used_bytes : self.used_bytes + len(raw)] = raw
        self.bytes_at[own] = self.used_bytes + V.offsets_of(rest)[:-1]
        self.words, self.used, self.used_bytes = many, self.used + len(flat), self.used_bytes + len(raw)
        return np.arange(n, many, dtype=np.int32)

    def _same(self, place: np.ndarray, data: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the kept words are these, byte by byte."""
        sizes = ends - starts
        same = (self.sizes[place] == sizes) & (self.beginnings[place] == V.beginnings(view, starts, ends))
        long_ = np.flatnonzero(same & (sizes > 8))
        rest = sizes[long_] - 8
        differ = data[V.ragged_take(starts[long_] + 8, rest)] != self.bytes[V.ragged_take(self.bytes_at[place[long_]], rest)]
        if differ.any():
            same[long_[np.bincount(V.row_of(rest)[differ], minlength=len(long_)) > 0]] = False
        return same

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all words in order, and the number of ids of each word. ``keys`` are the words' hashes."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        view = V.eights(data)
        if keys is None:
            keys = V.word_hash(data, starts, ends, view=view)
        place = self._find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            if (self.words + len(distinct) > self.limit or self.used_bytes > self.limit_bytes) and self.words:
                self._clear()
                return self.ids_of(data, starts, ends, keys)
            if len(distinct) > self.limit:
                self.bits = len(distinct).bit_length() + 1
                self._clear()
                distinct, first = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
            self._insert(distinct, self._add(data, view, starts[new[first]], ends[new[first]]))
            place[new] = self._find(keys[new])
        for i in np.flatnonzero(~self._same(place, data, view, starts, ends)).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in self.others:
                self.others[word] = int(self._add(data, view, starts[i : i + 1], ends[i : i + 1])[0])
            place[i] = self.others[word]
        counts = self.lengths[place].astype(np.int64)
        return self.ids[V.ragged_take(self.starts[place].astype(np.int64), counts)], counts
