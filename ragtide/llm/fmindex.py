"""A compressed full-text index of many short texts, searched for many patterns at once.

The Burrows-Wheeler transform of the collection (each text ends in its own terminator, terminators in the order of
the texts) is kept as a wavelet matrix of packed bit vectors with rank counts. A search step narrows the suffix
intervals of all patterns that are still active, one rank descent over the levels for both interval ends.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) + 64
        packed = np.packbits(np.concatenate([bits, np.zeros(n - len(bits) + (-n) % 64, bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones are before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    def __init__(self, codes: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, now = [], codes
        for level in range(self.depth - 1, -1, -1):
            bits = ((now >> level) & 1).astype(bool)
            self.levels.append(BitVector(bits))
            now = np.concatenate([now[~bits], now[bits]])
        self.start = np.zeros(1 << self.depth, np.int64)
        every = np.arange(1 << self.depth)
        self.start = self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, codes: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = bits.ones(i)
            i = np.where((codes >> level) & 1, bits.zeros + one, i - one)
        return i

    def rank(self, codes: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each code occurs before its position i."""
        return self._descend(codes, i) - self.start[codes]


def suffix_order(codes: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; codes of characters are from 1, terminators are 0.

    A suffix ends at the terminator of its text (``ends``: the position of the terminator at or after each position);
    equal ones are in the order of the texts.
    """
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    width = 62 // bits
    place = np.arange(n)
    key, padded = np.zeros(n, np.int64), np.concatenate([codes.astype(np.int64), np.zeros(width, np.int64)])
    for k in range(width):
        key = (key << bits) | np.where(place + k <= ends, padded[k : k + n], 0)
    reach = width
    while True:
        order = np.argsort(key, kind="stable")
        step = key[order]
        new = np.concatenate([[True], step[1:] != step[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all() or reach > longest:
            return order
        beyond = place + reach
        second = np.where(beyond <= ends, rank[np.minimum(beyond, n - 1)], 0)
        key = rank * (n + 1) + second
        reach *= 2


class FmIndex:
    """An index of texts, each owned by a record; searches ask for occurrences in a text of another record."""

    def __init__(self, texts: list[str], owners: np.ndarray) -> None:
        points = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(points), bool)
        inner[stops] = False
        self.alphabet, found = np.unique(points[inner], return_inverse=True)
        codes = np.zeros(len(points), np.int64)
        codes[inner] = found + 1
        text_of = np.repeat(np.arange(len(texts)), sizes + 1)
        order = suffix_order(codes, stops[text_of], int(sizes.max(initial=0)) + 1)
        first = np.concatenate([[0], stops[:-1] + 1])
        before = codes[order - 1]
        before[np.isin(order, first)] = 0
        sigma = len(self.alphabet) + 1
        self.matrix = WaveletMatrix(before, sigma)
        self.lower = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])[:-1]
        self.owner = owners[text_of[order]]
        change = np.concatenate([self.owner[1:] != self.owner[:-1], [True]])
        at = np.where(change, np.arange(1, len(order) + 1), len(order) + 1)
        self.change = np.minimum.accumulate(at[::-1])[::-1]  # the first later suffix of another owner
        self.n, self.codes, self.first, self.sizes, self.owners = len(order), codes, first, sizes, owners

    def _narrow(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix intervals one character further to the left, and whether they hold a suffix of another owner."""
        both = self.matrix.rank(np.concatenate([code, code]), np.concatenate([lo, hi]))
        low, high = self.lower[code] + both[: len(code)], self.lower[code] + both[len(code) :]
        first = np.minimum(low, self.n - 1)
        return low, high, (high > low) & ((self.owner[first] != own) | (self.change[first] < high))

    def ends_shared(self, which: np.ndarray, length: int) -> np.ndarray:
        """Whether the last ``length`` characters of each text of ``which`` occur in a text of another owner."""
        base, size, own = self.first[which], self.sizes[which], self.owners[which]
        result = np.zeros(len(which), bool)
        live = np.flatnonzero(size >= length)
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for step in range(1, length + 1):
            if not len(live):
                return result
            lo[live], hi[live], foreign = self._narrow(self.codes[base[live] + size[live] - step], lo[live], hi[live], own[live])
            live = live[foreign]
        result[live] = True
        return result

    def leftmost(self, which: np.ndarray, length: int) -> np.ndarray:
        """For each text of ``which`` the start of its leftmost window of ``length`` characters that occurs in a text of another owner, or -1.

        A window is matched backwards from its end. Where the match stops short, no window that holds the
        unmatched stretch can occur, so the next one starts behind the stretch's first character.
        """
        base, size, own = self.first[which], self.sizes[which], self.owners[which]
        begin = np.zeros(len(which), np.int64)
        result = np.full(len(which), -1, np.int64)
        live = np.flatnonzero(size >= length)
        at = begin + length  # characters [at, begin + length) are matched
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        while len(live):
            at[live] -= 1
            code = self.codes[base[live] + at[live]]
            lo[live], hi[live], foreign = self._narrow(code, lo[live], hi[live], own[live])
            done = live[foreign & (at[live] == begin[live])]
            result[done] = begin[done]
            fail = live[~foreign]
            begin[fail] = at[fail] + 1
            at[fail] = begin[fail] + length
            lo[fail], hi[fail] = 0, self.n
            over = fail[begin[fail] + length > size[fail]]
            gone = np.zeros(len(which), bool)
            gone[done] = gone[over] = True
            live = live[~gone[live]]
        return result


def shared_ranges(texts: list[str], owners: np.ndarray, which: np.ndarray, length: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text of ``which`` the start of its leftmost and the end of its rightmost window that another owner's text holds; -1 if none.

    Where the last window of a text is shared, one backward search from its end shows it. Else the rightmost window is the leftmost of the
    reversed texts, in an index of their own; with ``groups`` (of the texts) of those groups that ask, so the end is that of windows shared within the group, or of the leftmost window where it is later.
    """
    index = FmIndex(texts, owners)
    left = index.leftmost(which, length)
    right = np.full(len(which), -1, np.int64)
    some = np.flatnonzero(left >= 0)
    if not len(some):
        return left, right
    at_end = index.ends_shared(which[some], length)
    right[some[at_end]] = index.sizes[which[some[at_end]]]
    open_ = some[~at_end]
    if len(open_):
        held = np.arange(len(texts)) if groups is None else np.flatnonzero(np.isin(groups, groups[which[open_]]))
        place = np.full(len(texts), -1, np.int64)
        place[held] = np.arange(len(held))
        back = FmIndex([texts[i][::-1] for i in held], owners[held]).leftmost(place[which[open_]], length)
        right[open_] = np.maximum(np.where(back >= 0, index.sizes[which[open_]] - back, -1), left[open_] + length)
    return left, right
